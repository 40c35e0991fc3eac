"""Announcements to a clean, de-duplicated, reviewable event listing, as DataFrame plans."""
