"""Vector code compression: product codes whose codebooks come from member-resident Lloyd rounds.

A vector is cut into parts; each part position has a codebook. Every part is a member of the owner (position, entry, salt) and lies in that owner's file. A round reads the members where they
lie: those that stay with their entry are only summed up, and those that another entry is now nearer to are dealt to their new owner by the shuffle. The update of an entry takes its
owners' sums and arrivals. No file is written again: a table of a round holds that round's arrivals, and whether an arrival has left since follows from the codebooks of the rounds in between,
which are few and small, so that no list of those that left is kept.

An entry with most of all parts is many owners, by the salt. What reaches the driver in a round is one row for each position and entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, table
from .vectors import integer_vectors, matrix, products

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: About so many members of an entry share an owner, if all vectors had that entry.
OWNER_ROWS = 8192
MEMBER = "vec_id long, position int, entry int, salt int, part array<long>, n long, arrived boolean"


def squared(x: np.ndarray) -> np.ndarray:
    """The squared length of each row."""
    if int(np.abs(x).max(initial=0)) ** 2 * max(1, x.shape[1]) < 1 << 62:
        return (x * x).sum(axis=1)
    return (x.astype(object) ** 2).sum(axis=1)


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of the nearest entry (the lower of equals) and the squared distance, for each row of integers."""
    far = squared(parts)[:, None] - 2 * products(parts, book) + squared(book)[None, :]
    at = far.argmin(axis=1)
    return at, far[np.arange(len(parts)), at]


def _members(positions, entries, salts, ids, parts: np.ndarray, n, arrived: bool) -> pa.RecordBatch:
    k, width = parts.shape
    lists = pa.ListArray.from_arrays(pa.array(np.arange(k + 1, dtype=np.int32) * width), pa.array(parts.reshape(-1), type=pa.int64()))
    columns = [pa.array(ids, type=pa.int64()), pa.array(positions, type=pa.int32()), pa.array(entries, type=pa.int32()), pa.array(salts, type=pa.int32()), lists, pa.array(n, type=pa.int64()), pa.array(np.full(k, arrived))]
    return pa.RecordBatch.from_arrays(columns, names=["vec_id", "position", "entry", "salt", "part", "n", "arrived"])


def first_owners(vectors: DataFrame, width: int, book: np.ndarray, salts: int) -> DataFrame:
    """vectors: vec_id, ints. A member for each part, at its nearest entry of book (position x entry x component)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = matrix(batch.column("ints"), width)
            ids, salt = batch.column("vec_id"), batch.column("salt").to_numpy()
            for p in range(len(book)):
                part = whole[:, p * book.shape[2] : (p + 1) * book.shape[2]]
                yield _members(np.full(len(part), p), nearest(part, book[p])[0], salt, ids, part, np.ones(len(part)), True)

    salted = vectors.select("vec_id", "ints", F.pmod(F.xxhash64("vec_id", "ints"), F.lit(salts)).cast("int").alias("salt"))
    return salted.mapInArrow(run, MEMBER)


def one_round(arrivals: list[DataFrame], books: list[np.ndarray]) -> DataFrame:
    """The members that change their entry under the last of books, at their new owner, and the sums of those that stay, at theirs.

    arrivals[g] are the members that came to their entry under books[g]. A member is still there if it has been nearest to it under every later book.
    """

    def stepped(since: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple, list] = {}
            for batch in batches:
                part = matrix(batch.column("part"), books[0].shape[2])
                position, entry, salt = (batch.column(c).to_numpy() for c in ("position", "entry", "salt"))
                here, goes = np.ones(len(part), dtype=bool), entry.astype(np.int64)
                for p in np.unique(position):
                    rows = np.flatnonzero(position == p)
                    for book in books[since + 1 : -1]:
                        rows = rows[nearest(part[rows], book[p])[0] == entry[rows]]
                    here[np.setdiff1d(np.flatnonzero(position == p), rows, assume_unique=True)] = False
                    goes[rows] = nearest(part[rows], books[-1][p])[0]
                moves = np.flatnonzero(here & (goes != entry))
                if len(moves):
                    yield _members(position[moves], goes[moves], salt[moves], batch.column("vec_id").take(pa.array(moves)), part[moves], np.ones(len(moves)), True)
                stays = np.flatnonzero(here & (goes == entry))
                owners, which = np.unique(np.stack([position[stays], entry[stays], salt[stays]], axis=1), axis=0, return_inverse=True)
                total = np.zeros((len(owners), part.shape[1]), dtype=np.int64)
                np.add.at(total, which.reshape(-1), part[stays])
                for owner, t, n in zip(map(tuple, owners.tolist()), total, np.bincount(which.reshape(-1), minlength=len(owners)), strict=True):
                    held = sums.setdefault(owner, [0, 0])
                    held[0], held[1] = held[0] + t, held[1] + int(n)
            if sums:
                keys = np.array(list(sums))
                yield _members(keys[:, 0], keys[:, 1], keys[:, 2], [None] * len(keys), np.stack([s for s, _ in sums.values()]), [n for _, n in sums.values()], False)

        return run

    out = None
    for g, df in enumerate(arrivals):
        part = df.where("arrived").mapInArrow(stepped(g), MEMBER)
        out = part if out is None else out.unionByName(part)
    return out


def train(vectors: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """vectors: vec_id, ints (see integer_vectors). The codebooks after so many rounds: position x entry x component.

    They start as the parts of the vectors with the smallest ids (nulls last, ties by the vector); with fewer vectors than entries there are fewer entries. An entry that no part has stays as it is.
    Repeated rows count as often as they are there. Rounds end as soon as no part moves, as all later ones would change nothing.
    """
    spark, size = vectors.sparkSession, width // parts
    starts = [r["ints"] for r in vectors.orderBy(F.asc_nulls_last("vec_id"), "ints").limit(entries).collect()]
    book = np.array(starts, dtype=np.int64).reshape(len(starts), parts, size).transpose(1, 0, 2)
    if not starts:
        return book
    books, folder = [book], fresh_path(spark, "lloyd")
    salts = max(1, -(-vectors.count() // OWNER_ROWS))
    arrivals: list[DataFrame] = []
    for k in range(rounds):
        moved = one_round(arrivals, books) if k else first_owners(vectors, width, book, salts)
        at = f"{folder}/{k}"
        moved.repartition("position", "entry", "salt").write.parquet(at)
        arrivals.append(spark.read.schema(MEMBER).parquet(at))
        owners = arrivals[-1].groupBy("position", "entry").agg(F.sum("n").alias("n"), F.count_if("arrived").alias("came"), *[F.sum(F.col("part")[j]).alias(f"s{j}") for j in range(size)])
        book, came = books[-1].copy(), 0
        for r in owners.collect():
            book[r["position"], r["entry"]] = [r[f"s{j}"] // r["n"] for j in range(size)]
            came += r["came"]
        if not came:
            break
        books.append(book)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)  # nothing reads the members any more
    return books[-1]


def encode(vectors: DataFrame, width: int, books: np.ndarray) -> DataFrame:
    """Replaces ints by code (two hex digits for each part) and error, the squared distances to the entries summed over the parts. Other columns stay."""
    kept = [f for f in vectors.schema.fields if f.name.lower() not in ("ints", "code", "error")]
    names = [f.name for f in kept]
    digits = np.array([f"{i:02x}" for i in range(max(256, books.shape[1]))], dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, size = matrix(batch.column("ints"), width), books.shape[2]
            code, error = np.full(len(whole), "", dtype=object), np.zeros(len(whole), dtype=object)
            for p in range(len(books)):
                at, far = nearest(whole[:, p * size : (p + 1) * size], books[p])
                code, error = code + digits[at], error + far.astype(object)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(code, type=pa.string()), pa.array(error, type=pa.int64())], names=[*names, "code", "error"])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], "code string", "error long"])
    return vectors.select(*names, "ints").mapInArrow(run, schema)


def compress(rows: DataFrame, vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """rows: vec_id (long) and a vector. Returns them without the vector, with code, error and codebooks_sha256 (all final components by part, entry and place, joined by commas).

    Rows whose vector is null or has a null or non-finite component aren't returned. Shorter vectors count as followed by zeros, and a width that the parts don't divide is filled up with
    zeros. Null ids and repeated rows are vectors like others; columns named code, error or codebooks_sha256 are replaced, others (texts of any length) pass through; an empty table gives no
    rows. A scaled component beyond 2**31 is an error.
    """
    vectors, width = integer_vectors(rows.drop("ints") if vector != "ints" else rows, vector, scale, parts)
    books = train(vectors.select("vec_id", "ints"), width, parts, entries, rounds)
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    return encode(vectors, width, books).withColumn("codebooks_sha256", F.lit(digest))


def with_label_error(coded: DataFrame) -> DataFrame:
    """Adds label_error: error summed over the rows of a label; null labels are one label."""
    coded = coded.drop("label_error")
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return with_label_error(compress(rows)).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _sql() -> str:
    """The same by plain Lloyd rounds in SQL: every round compares every part with every entry."""
    steps = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS r, * FROM (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(x::DOUBLE * {SCALE}) AS BIGINT)) AS v "
        "FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0))",
        f"parts AS MATERIALIZED (SELECT r, p, list_slice(v, p * len(v) // {PARTS} + 1, (p + 1) * len(v) // {PARTS}) AS v FROM kept, range({PARTS}) t(p))",
        f"c0 AS MATERIALIZED (SELECT p, r - 1 AS e, v FROM parts WHERE r <= {ENTRIES})",
    ]
    far = "list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for k in range(ROUNDS + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT r, p, min(d).e AS e, min(d).d AS d FROM (SELECT x.r, x.p, {{'d': CAST({far} AS BIGINT), 'e': c.e}} AS d FROM parts x JOIN c{k} c USING (p)) GROUP BY r, p)")
        if k < ROUNDS:
            mean = f"SELECT p, e, list(m ORDER BY j) AS v FROM (SELECT p, e, j, CAST(floor(sum(x) / count(*)) AS BIGINT) AS m FROM (SELECT a.p, a.e, unnest(range(len(x.v))) AS j, unnest(x.v) AS x FROM a{k} a JOIN parts x USING (r, p)) GROUP BY p, e, j) GROUP BY p, e"
            steps.append(f"m{k} AS MATERIALIZED ({mean})")
            steps.append(f"c{k + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN m{k} m USING (p, e))")
    last = ROUNDS
    return (
        "WITH " + ", ".join(steps) + f", coded AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{last} GROUP BY r), "
        f"book AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{last}) "
        "SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN coded USING (r), book"
    )


OP12_SQL = _sql()
