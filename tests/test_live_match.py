"""What a unit of the live match looks at."""

import dataclasses

import pandas as pd

from posterboard.operators import live_match as M


def test_a_pair_of_keys_is_compared_once_in_a_unit():
    """Blocks of the right go by one after another: likenesses are remembered, and blocks that can't be better aren't looked at. The outcome is that of one block."""
    calls = []
    measure = dataclasses.replace(M.NAMES, exact=lambda a, b: calls.append((a, b)) or M.NAMES.exact(a, b))
    l = pd.DataFrame({"day": [100, 103, 100], "title": ["order five low", "open day", ""], "place": ["customer 400", "customer 12", "customer 7"], "state": ["", "", ""], "id": 0, "flagged": False, "side": 0})
    r = pd.DataFrame([(day, f"order {k % 5} low", f"customer {k}", "", k, k % 2 == 0, 1) for day in (103, 102, 101, 100, 98) for k in range(day, day + 60)], columns=["day", "title", "place", "state", "id", "flagged", "side"])
    unit = pd.concat([l, r], ignore_index=True).assign(cell=1, at_l=0, part_r=0)
    outcomes = []
    for block in (7, 1000):
        calls.clear()
        batches = [unit.iloc[at : at + 50] for at in range(0, len(unit), 50)]
        outcomes.append(pd.concat(M._through(iter(batches), measure, block)).sort_values(["day", "title"]).reset_index(drop=True))
        assert len(calls) == len(set(calls))
    assert len(outcomes[0]) == 3 and outcomes[0].equals(outcomes[1])
