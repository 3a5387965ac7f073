"""Vector code compression: integer product quantisation by Hamerly's form of Lloyd's method.

Vectors are cut into equal consecutive parts; each part position has a codebook, fitted
by rounds of assigning every part to its nearest entry and moving every entry to the
floored mean of its parts. Assignments are exact: squared distances are integers, ties go
to the lower index.

Every part carries the entry it is assigned to, an upper bound of its distance to that
entry and a lower bound of its distance to the second nearest. Entries move from round to
round; the bounds are loosened by how far they moved. While the upper bound is strictly
below the lower one, or below half the distance from the entry to the next one, no other
entry can be as near, and the part keeps its entry without a look at the codebook. Else the
upper bound is tightened first, and only where it still fails all entries are scanned. A
tie fails the strict test, so the lower index wins as in a plain scan. Bounds are
floating-point numbers rounded away from each other (``SLACK``).

A round is one pass over a table in the shared folder, which holds vectors and bounds, and
one aggregation of sums per (part, entry, position); only codebooks (parts x entries x width
integers) reach the driver and the tasks.

Defined results: rows whose vector is null or holds null or non-finite components are
dropped, as are vectors of another length than most or that cannot be cut into the parts;
components are cut to 2**28 after scaling; repeated rows count as often as they come;
rows without an id come last among those that codebooks start from, equal ids go by
vector; with fewer rows than entries each row starts an entry; entries that no part
is nearest to stay; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandspark.llm.vectors import integer_vectors, lists, matrix
from strandspark.runtime import forget, written


@dataclass(frozen=True)
class CodeConfig:
    scale: int = 4096
    parts: int = 8
    entries: int = 16
    rounds: int = 6


#: Relative widening of the bounds at each step, far over the rounding of doubles.
SLACK = 1e-12
#: Integers of a block of differences between parts and entries.
BLOCK = 1 << 21


def nearest_two(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest entry, its squared distance, that of the second nearest) of each row; ties to
    the lower index. With one entry the second is infinitely far."""
    k = len(book)
    at, first, second = np.empty(len(x), np.int64), np.empty(len(x), np.int64), np.full(len(x), np.inf)
    rows = max(1, BLOCK // max(1, book.size))
    for s in range(0, len(x), rows):
        d = ((x[s : s + rows, None, :] - book[None]) ** 2).sum(2)
        at[s : s + rows] = d.argmin(1)
        first[s : s + rows] = d.min(1)
        if k > 1:
            second[s : s + rows] = np.partition(d, 1, 1)[:, 1]
    return at, first, second


def to_entry(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    return ((x - entries) ** 2).sum(1)


@dataclass
class Movement:
    """What the bounds of one part position need to know of the step to the present codebook."""

    #: How far each entry moved, and the largest way of any other entry.
    own: np.ndarray
    others: np.ndarray
    #: Half the distance of each entry to the next one.
    half: np.ndarray

    @staticmethod
    def between(old: np.ndarray, new: np.ndarray) -> Movement:
        own = np.sqrt(((new - old) ** 2).sum(1).astype(float)) * (1 + SLACK)
        k = len(new)
        others, half = np.zeros(k), np.full(k, np.inf)
        for i in range(k):
            rest = np.arange(k) != i
            if rest.any():
                others[i] = own[rest].max()
                half[i] = np.sqrt(((new[rest] - new[i]) ** 2).sum(1).min().astype(float)) / 2 * (1 - SLACK)
        return Movement(own, others, half)


def reassign(x: np.ndarray, book: np.ndarray, at: np.ndarray, upper: np.ndarray, lower: np.ndarray, moved: Movement) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(entry, upper, lower, scans) of the rows of one part position after the entries moved."""
    upper = (upper + moved.own[at]) * (1 + SLACK)
    lower = lower * (1 - SLACK) - moved.others[at]
    bound = np.maximum(lower, moved.half[at])
    loose = np.flatnonzero(~(upper < bound))
    if len(loose):
        upper[loose] = np.sqrt(to_entry(x[loose], book[at[loose]]).astype(float)) * (1 + SLACK)
        loose = loose[~(upper[loose] < bound[loose])]
    if len(loose):
        at = at.copy()
        at[loose], first, second = nearest_two(x[loose], book)
        upper[loose], lower[loose] = np.sqrt(first.astype(float)) * (1 + SLACK), np.sqrt(second) * (1 - SLACK)
    return at, upper, lower, len(loose)


STATE = "vec_id {id}, label {label}, x array<bigint>, entry array<int>, upper array<double>, lower array<double>"


def _first_round(books: np.ndarray, it):
    parts, _, width = books.shape
    for b in it:
        x = matrix(b.column("x"), parts * width).reshape(-1, parts, width)
        at, first, second = (np.stack(c, 1) for c in zip(*[nearest_two(x[:, p], books[p]) for p in range(parts)]))
        bounds = np.sqrt(first.astype(float)) * (1 + SLACK), np.sqrt(second) * (1 - SLACK)
        yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), b.column("x"), lists(at, pa.int32()), *[lists(v, pa.float64()) for v in bounds]], names=["vec_id", "label", "x", "entry", "upper", "lower"])


def _moved(b: pa.RecordBatch, books: np.ndarray, moves: list[Movement]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    parts, _, width = books.shape
    x = matrix(b.column("x"), parts * width).reshape(-1, parts, width)
    at, upper, lower = matrix(b.column("entry"), parts).astype(np.int64), matrix(b.column("upper"), parts), matrix(b.column("lower"), parts)
    done = [reassign(x[:, p], books[p], at[:, p], upper[:, p], lower[:, p], moves[p]) for p in range(parts)]
    return x, *(np.stack([d[i] for d in done], 1) for i in range(3))


def _next_round(books: np.ndarray, moves: list[Movement], it):
    for b in it:
        _, at, upper, lower = _moved(b, books, moves)
        yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), b.column("x"), lists(at, pa.int32()), lists(upper, pa.float64()), lists(lower, pa.float64())], names=["vec_id", "label", "x", "entry", "upper", "lower"])


def _last_round(books: np.ndarray, moves: list[Movement], it):
    for b in it:
        x, at, _, _ = _moved(b, books, moves)
        error = sum((to_entry(x[:, p], books[p][at[:, p]]) for p in range(len(books))), np.zeros(len(x), np.int64))
        code = ["".join(f"{e:02x}" for e in row) for row in at.tolist()]
        yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(code, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])


def _sums(shape: tuple[int, int, int], it):
    """Sums and counts of a task's rows by (part, entry, position)."""
    parts, entries, width = shape
    total, count = np.zeros(shape, np.int64), np.zeros((parts, entries), np.int64)
    for b in it:
        x, at = matrix(b.column("x"), parts * width).reshape(-1, parts, width), matrix(b.column("entry"), parts)
        for p in range(parts):
            for e in range(entries):
                own = x[at[:, p] == e, p]
                total[p, e] += own.sum(0)
                count[p, e] += len(own)
    p, e, j = (i.ravel() for i in np.indices(shape))
    used = count[p, e] > 0
    columns = [p[used].astype(np.int32), e[used].astype(np.int32), j[used].astype(np.int32), total.ravel()[used], count[p, e][used]]
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["part", "entry", "place", "total", "n"])


def _means(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks of floored means; entries without parts stay."""
    shape = books.shape
    rows = state.select("x", "entry").mapInArrow(lambda it: _sums(shape, it), "part int, entry int, place int, total long, n long").groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    out = books.copy()
    for r in rows.collect():  # as many as the codebooks have integers
        out[r["part"], r["entry"], r["place"]] = r["total"] // r["n"]
    return out


@dataclass
class Compressed:
    #: vec_id, label, code (two hex digits a part) and error (squared distance to the entries).
    rows: DataFrame
    #: parts x entries x width integers; None where no row takes part.
    books: np.ndarray | None

    def sha256(self) -> str:
        """Digest of all entries' integers by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, [] if self.books is None else self.books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, config: CodeConfig = CodeConfig(), id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> Compressed:
    """Codebooks fitted on all rows, and every row's code."""
    own, length = integer_vectors(vectors, config.scale, vec_col, {"vec_id": id_col, "label": label_col}, config.parts)
    kinds = dict(own.dtypes)
    if not length:
        return Compressed(own.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), None)
    base = written(own, "code-vectors")
    seeds = [r["x"] for r in base.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(config.entries).select("x").collect()]
    books = np.array(seeds, np.int64).reshape(len(seeds), config.parts, -1).transpose(1, 0, 2).copy()
    schema = STATE.format(id=kinds["vec_id"], label=kinds["label"])
    step = lambda it, books=books: _first_round(books, it)
    state = base
    for _ in range(config.rounds):
        after = written(state.mapInArrow(step, schema), "code-bounds")
        forget(state)
        state = after
        new = _means(state, books)
        moves = [Movement.between(a, b) for a, b in zip(books, new)]
        books = new
        step = lambda it, books=books, moves=moves: _next_round(books, moves, it)
    if not config.rounds:
        state = written(base.mapInArrow(step, schema), "code-bounds")
        moves = [Movement.between(b, b) for b in books]
    last = lambda it, books=books, moves=moves: _last_round(books, moves, it)
    rows = written(state.mapInArrow(last, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"), "codes")
    forget(state)
    return Compressed(rows, books)


def decode(codes: DataFrame, books: np.ndarray, scale: int = CodeConfig.scale) -> DataFrame:
    """``codes`` with ``approx``: the vectors that their codes stand for, at the middle of the integers' cells."""
    kinds = ", ".join(f"`{n}` {t}" for n, t in codes.dtypes)

    def run(it):
        for b in it:
            at = np.array([list(bytes.fromhex(c)) for c in b.column("code").to_pylist()], np.int64).reshape(-1, len(books))
            whole = np.concatenate([books[p][at[:, p]] for p in range(len(books))], 1)
            yield pa.RecordBatch.from_arrays([*b.columns, lists((whole + 0.5) / scale, pa.float64())], names=[*b.schema.names, "approx"])

    return codes.mapInArrow(run, f"{kinds}, approx array<double>")


def with_label_error(rows: DataFrame) -> DataFrame:
    """Add ``label_error``: the errors of all rows with that label, nulls together. Sums are
    combined before the shuffle; the join with them is one that Spark can split."""
    sums = rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return rows.join(sums, F.col("label").eqNullSafe(F.col("of"))).drop("of")
