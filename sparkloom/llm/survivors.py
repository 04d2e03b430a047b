"""One surviving record per group of reports of the same thing, by token-level consensus.

The values of a field within a group are aligned token by token to a profile that grows with them. In each
column of the profile the tokens vote, against the values that have none there; the winners are the consensus,
and the existing value closest to it survives. What a vote is worth is the policy:

* `summed`: weights add up, so the values that agree carry the day;
* `ranked`: the token of the highest rank wins (trust, then time, then smallest id), whatever the others say. So
  the consensus reads like the value of the highest rank, and of the rows that read so the highest is taken.

Equal values are brought together before anything is shuffled, then one shuffle by group, in order of the votes.
A task keeps the values of one group, `MOST_VALUES` at most; what a larger group has beyond that passes through
to a further step. A group that holds a large share of all values is spread over salts: each builds its own
profile, and profiles are aligned to each other.

Defined results: groups of one row have no survivor; a field without a usable (not null, not blank) value gives
no row; null weights count as 0, weights count in millionths (plus one for each row); null ranks are lowest; ties
go to the smaller value (summed) or the smallest row id (ranked). Tokens are compared in lower case; values may be
any length: long ones are aligned by rows of arrays, in memory of one row where the whole table would be large.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.operators.skew import HOT_SHARE, bounded_broadcast, hot_keys, salted_join
from sparkloom.session import written

#: So many values of one group are kept by a task.
MOST_VALUES = 20_000
_SMALL, _WHOLE = 600, 4_000_000  # cells: up to here plain lists, up to here one table
_LOWEST = -(1 << 63)


# Alignment ---------------------------------------------------------------------------------
def _small_table(match: list[list[int]], gap_a: list[int], gap_b: list[int]) -> list[list[int]]:
    row = [0]
    for b in gap_b:
        row.append(row[-1] + b)
    table = [row]
    for costs, a in zip(match, gap_a, strict=True):
        above, row = row, [row[0] + a]
        for j, c in enumerate(costs):
            row.append(min(above[j] + c, above[j + 1] + a, row[j] + gap_b[j]))
        table.append(row)
    return table


def _next_row(above: np.ndarray, costs: np.ndarray, a: int, run: np.ndarray) -> np.ndarray:
    """A row of the table from the one above; `run` are the running sums of what skipping in b costs."""
    row = above + a
    row[1:] = np.minimum(row[1:], above[:-1] + costs)
    return np.minimum.accumulate(row - run) + run


def _matched(table, match, gap_a, gap_b) -> list[tuple[int, int]]:  # noqa: ANN001
    """Which of a go with which of b; of equally cheap ways the one that matches leftmost."""
    i, j, out = len(gap_a), len(gap_b), []
    while i and j:
        if table[i][j] == table[i][j - 1] + gap_b[j - 1]:
            j -= 1
        elif table[i][j] == table[i - 1][j] + gap_a[i - 1]:
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def best_matches(match_row, gap_a: list[int], gap_b: list[int]) -> list[tuple[int, int]]:  # noqa: ANN001
    """Pairs (i, j) of the cheapest alignment of a with b; match_row(i) gives the costs of matching a's i with each of b."""
    n, m = len(gap_a), len(gap_b)
    if n * m <= _SMALL:
        match = [match_row(i) for i in range(n)]
        return _matched(_small_table(match, gap_a, gap_b), match, gap_a, gap_b)
    costs = lambda i: np.asarray(match_row(i), np.int64)
    b = np.asarray(gap_b, np.int64)
    if n * m <= _WHOLE or n < 2:
        run = np.concatenate([[0], np.cumsum(b)])
        table = [run]
        for i in range(n):
            table.append(_next_row(table[-1], costs(i), gap_a[i], run))
        return _matched(table, None, gap_a, gap_b)
    half = n // 2  # split where the two halves are cheapest together, then each by itself
    run, back = np.concatenate([[0], np.cumsum(b)]), np.concatenate([[0], np.cumsum(b[::-1])])
    above, below = run, back
    for i in range(half):
        above = _next_row(above, costs(i), gap_a[i], run)
    for i in range(n - 1, half - 1, -1):
        below = _next_row(below, costs(i)[::-1], gap_a[i], back)
    k = int(np.argmin(above + below[::-1]))
    left = best_matches(lambda i: match_row(i)[:k], gap_a[:half], gap_b[:k])
    right = best_matches(lambda i: match_row(half + i)[k:], gap_a[half:], gap_b[k:])
    return left + [(half + i, k + j) for i, j in right]


class Profile:
    """The alignment of a group's values so far.

    Each column has its tokens with how many values have them there, their votes, and the vote of the values
    without a token there. Costs are those of pairs of values: a pair costs one where its tokens differ.
    """

    def __init__(self, ranked: bool) -> None:
        self.join, self.none = (max, ()) if ranked else (add, 0)
        self.columns: list[tuple[dict, dict, object]] = []
        self.total, self.vote = 0, self.none

    def add(self, tokens: list[str], vote, count: int = 1) -> None:  # noqa: ANN001
        one = self if not self.total else Profile(self.join is max)
        one.columns = [({t: count}, {t: vote}, self.none) for t in tokens]
        one.total, one.vote = count, vote
        if one is not self:
            self.merge(one)

    def _match_row(self, other: Profile):  # noqa: ANN202
        places: dict[str, list[tuple[int, int]]] = {}
        for j, (tokens, _, _) in enumerate(other.columns):
            for t, n in tokens.items():
                places.setdefault(t, []).append((j, n))
        lack = [other.total - sum(tokens.values()) for tokens, _, _ in other.columns]
        both, some = self.total * other.total, any(lack)
        small = len(self.columns) * len(other.columns) <= _SMALL

        def row(i: int):  # noqa: ANN202
            tokens = self.columns[i][0]
            missing = self.total - sum(tokens.values())
            if small:
                out = [both - missing * x for x in lack] if some and missing else [both] * len(lack)
            else:
                out = both - missing * np.array(lack, np.int64)
            for t, n in tokens.items():
                for j, k in places.get(t, ()):
                    out[j] -= n * k
            return out

        return row

    def merge(self, other: Profile) -> None:
        """Take in another profile, column by column."""
        if not self.total:
            self.columns, self.total, self.vote = other.columns, other.total, other.vote
            return
        if [c[0].keys() for c in self.columns] == [c[0].keys() for c in other.columns]:
            pairs = [(i, i) for i in range(len(self.columns))]
        else:
            gap_a = [sum(c[0].values()) * other.total for c in self.columns]
            gap_b = [sum(c[0].values()) * self.total for c in other.columns]
            pairs = best_matches(self._match_row(other), gap_a, gap_b)
        join, out, i, j = self.join, [], 0, 0
        for x, y in [*pairs, (len(self.columns), len(other.columns))]:
            for tokens, votes, gap in self.columns[i:x]:
                out.append((tokens, votes, join(gap, other.vote)))
            for tokens, votes, gap in other.columns[j:y]:
                out.append((tokens, votes, join(gap, self.vote)))
            if x < len(self.columns) and y < len(other.columns):
                (tokens, votes, gap), (more, own, lack) = self.columns[x], other.columns[y]
                tokens = tokens | {t: tokens.get(t, 0) + n for t, n in more.items()}
                votes = votes | {t: join(votes.get(t, self.none), v) for t, v in own.items()}
                out.append((tokens, votes, join(gap, lack)))
            i, j = x + 1, y + 1
        self.columns, self.total, self.vote = out, self.total + other.total, join(self.vote, other.vote)

    def consensus(self) -> list[str]:
        """The token with the strongest vote of each column, unless the values without a token there are stronger."""
        best = [(max((v, t) for t, v in votes.items()), gap) for _, votes, gap in self.columns]
        return [t for (v, t), gap in best if v >= gap]

    def dumps(self) -> str:
        return json.dumps([self.join is max, self.total, self.vote, self.columns])

    @classmethod
    def loads(cls, text: str) -> Profile:
        ranked, total, vote, columns = json.loads(text)
        plain = (lambda v: tuple(v)) if ranked else (lambda v: v)
        out = cls(ranked)
        out.total, out.vote = total, plain(vote)
        out.columns = [(tokens, {t: plain(v) for t, v in votes.items()}, plain(gap)) for tokens, votes, gap in columns]
        return out


def token_distance(a: list[str], b: list[str]) -> int:
    """Tokens to change, add or leave out to make b of a."""
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    a, b = a[k:], b[k:]
    if len(a) * len(b) <= _SMALL:
        return _small_table([[int(x != y) for y in b] for x in a], [1] * len(a), [1] * len(b))[-1][-1]
    known: dict[str, int] = {}
    ids, run = np.array([known.setdefault(x, len(known)) for x in b]), np.arange(len(b) + 1)
    row = run
    for x in a:
        row = _next_row(row, (ids != known.get(x, -1)).astype(np.int64), 1, run)
    return int(row[-1])


def tokens_of(value: str) -> list[str]:
    return value.lower().split()


# The operator ------------------------------------------------------------------------------
def _boundaries(batch: pa.RecordBatch, keys: list[str], last: tuple | None) -> tuple[list[int], tuple | None]:
    """Where a new group begins in a batch sorted by group, and the key of its last row."""
    n = batch.num_rows
    new = np.zeros(n, bool)
    for k in keys:
        c = batch.column(batch.schema.get_field_index(k))
        if n > 1:
            same = pc.fill_null(pc.equal(c[1:], c[:-1]), False).to_numpy(zero_copy_only=False)
            nulls = c.is_null().to_numpy(zero_copy_only=False)
            new[1:] |= ~(same | (nulls[1:] & nulls[:-1]))
    at = lambda i: tuple(batch.column(batch.schema.get_field_index(k))[i].as_py() for k in keys)
    new[0] = at(0) != last
    return np.flatnonzero(new).tolist(), at(n - 1)


class _Group:
    """What a task has of one group, field and salt; `head` is its first row, by place in the batch at hand or as a batch of one."""

    def __init__(self, ranked: bool, head: int | pa.RecordBatch, big: bool) -> None:
        self.profile, self.head, self.big = Profile(ranked), head, big
        self.values: list[tuple] = []
        self.n, self.least = 0, None

    def take(self, value: str | None, count: int, least: int, weight: int, rank: list[int] | None) -> None:
        self.n += count
        self.least = least if self.least is None else min(self.least, least)
        if value is not None:
            self.values.append((tokens_of(value), value, weight, rank, least))

    def align(self) -> list[str]:
        """Take the values into the profile and give its consensus; values that all read alike need no aligning."""
        if not self.big and all(v[0] == self.values[0][0] for v in self.values):
            return self.values[0][0]
        for tokens, _, weight, rank, _ in self.values:
            self.profile.add(tokens, tuple(rank) if rank is not None else weight)
        return self.profile.consensus()


def closest(consensus: list[str], values: list[tuple], ranked: bool) -> tuple:
    """Of (tokens, value, weight, rank, row) the one nearest the consensus; then the highest rank, or the heaviest and smallest."""
    exact = [v for v in values if v[0] == consensus]
    near = [(0, v) for v in exact] or [(token_distance(consensus, v[0]), v) for v in values]
    least = min(d for d, _ in near)
    near = [v for d, v in near if d == least]
    return max(near, key=lambda v: v[3]) if ranked else min(near, key=lambda v: (-v[2], v[1]))


def consensus_survivors(df: DataFrame, group: list[str], row_id: str, fields: dict[str, Column], *, weight: Column | None = None, rank: list[Column] | None = None, most: int = MOST_VALUES) -> DataFrame:
    """(group_id, field, consensus, value, row_id): for each field of each group of two or more rows the survivor.

    `fields` gives each field's value, null where it isn't usable. With `rank` (whole numbers, compared in order, the
    row id last) votes are ranked and row_id is the row of the highest rank with that value; else votes are sums of
    `weight` and row_id is the smallest with that value. group_id is the smallest row id of the group.
    """
    ranked = rank is not None
    keys = [f"__sl_g{i}" for i in range(len(group))]
    order = F.struct(*[F.coalesce(r.cast("bigint"), F.lit(_LOWEST)).alias(f"r{i}") for i, r in enumerate([*(rank or []), -F.col(row_id)])])
    of_field = F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.when(F.trim(v) != "", v).alias("value")) for k, v in fields.items()])).alias("x")
    given = [order.alias("rank")] if ranked else [F.coalesce(weight, F.lit(0)).cast("double").alias("w")]
    rows = df.select(*[F.col(g).alias(k) for g, k in zip(group, keys, strict=True)], F.col(row_id).cast("bigint").alias("id"), *given, of_field).select("*", "x.field", "x.value")
    own = [F.max("rank").alias("rank")] if ranked else [(F.round(F.sum("w") * 10**6).cast("bigint") + F.count(F.lit(1))).alias("w")]
    values = rows.groupBy(*keys, "field", "value").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"), *own)
    if ranked:
        values = values.withColumn("rank", F.array(*[F.col(f"rank.r{i}") for i in range(len(rank) + 1)])).withColumn("w", F.lit(0).cast("bigint"))
    else:
        values = values.withColumn("rank", F.lit(None).cast("array<bigint>"))
    values = written(values)
    keyed = [*keys, "field"]
    hot = hot_keys(values, keyed, least=most)
    salts = F.coalesce(F.create_map(*[F.lit(x) for pair in hot.items() for x in pair])[F.xxhash64(*keyed)], F.lit(1)) if hot else F.lit(1)
    salted = values.withColumn("salts", salts).withColumn("salt", F.pmod(F.xxhash64("value"), F.col("salts")).cast("int"))
    first = F.col("rank").desc() if ranked else F.col("w").desc()
    sorted_ = salted.repartition(*keyed, "salt").sortWithinPartitions(*keyed, "salt", first, F.desc("value"))
    kinds = [*[values.schema[k] for k in keys], T.StructField("field", T.StringType())]
    made = [T.StructField(c, t) for c, t in {"kind": T.StringType(), "n": T.LongType(), "least": T.LongType(), "consensus": T.StringType(), "value": T.StringType(), "row_id": T.LongType(), "w": T.LongType(), "rank": T.ArrayType(T.LongType())}.items()]

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, now = None, None
        types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()))

        def emit(done: list[tuple], heads: list, batch: pa.RecordBatch | None) -> Iterator[pa.RecordBatch]:
            """The rows made, each behind its group's keys; a group carried over from an earlier batch comes first."""
            carried = [h for h in heads if not isinstance(h, int)]
            for part, rows, source in ((done[: len(carried)], [0] * len(carried), carried[0] if carried else None), (done[len(carried) :], [h for h in heads if isinstance(h, int)], batch)):
                if part:
                    kept = source.select(keyed).take(pa.array(rows, pa.int32()))
                    yield pa.RecordBatch.from_arrays([*kept.columns, *[pa.array([d[i] for d in part], t) for i, t in enumerate(types)]], names=[*keyed, *[f.name for f in made]])

        def passed(g: _Group, done: list, heads: list) -> None:
            g.align()
            done += [("value", None, None, None, value, row, w, rank_) for _, value, w, rank_, row in g.values]
            heads += [g.head] * len(g.values)
            g.values = []

        def finish(g: _Group, done: list, heads: list) -> None:
            if g.big:
                passed(g, done, heads)
                done.append(("part", g.n, g.least, g.profile.dumps(), None, None, None, None))
                heads.append(g.head)
            elif g.n > 1 and g.values:
                consensus = g.align()
                _, value, w, rank_, row = closest(consensus, g.values, ranked)
                done.append(("done", g.n, g.least, " ".join(consensus), value, -rank_[-1] if ranked else row, w, rank_))
                heads.append(g.head)

        for x in batches:
            if not x.num_rows:
                continue
            col = lambda c: x.column(x.schema.get_field_index(c)).to_pylist()  # noqa: E731, B023
            starts, last = _boundaries(x, [*keyed, "salt"], last)
            begins, done, heads = set(starts), [], []
            for i, (value, n, least, w, rank_, salts_) in enumerate(zip(*map(col, ("value", "n", "least", "w", "rank", "salts")), strict=True)):
                if i in begins:
                    if now is not None:
                        finish(now, done, heads)
                    now = _Group(ranked, i, salts_ > 1)
                now.take(value, n, least, w, rank_)
                if len(now.values) >= most:
                    now.big = True
                    passed(now, done, heads)
            yield from emit(done, heads, x)
            if isinstance(now.head, int):
                now.head = x.slice(now.head, 1)
        if now is not None:
            done, heads = [], []
            finish(now, done, heads)
            yield from emit(done, heads, None)

    found = sorted_.mapInArrow(convert, T.StructType([*kinds, *made]))
    wanted = ["least AS group_id", "field", "consensus", "value", "row_id"]
    if not hot and values.count() * HOT_SHARE <= most:  # then no group has more than `most`
        return found.where("kind = 'done'").selectExpr(*wanted)
    found = written(found)
    one = F.to_json(F.struct(*keyed)).alias("__sl_key")  # null keys are keys too
    merged = written(_merged(found.where("kind = 'part'").select(one, "least", "n", "consensus")))
    many = found.where("kind = 'value'").select(one, "field", "value", "w", "rank", "row_id")
    groups = merged.count()  # one for each group of more than `most` values
    small = bounded_broadcast(merged, groups, 1024)
    near = many.join(small, "__sl_key") if small is not merged else salted_join(many, merged, ["__sl_key"], ["value"], hot_keys(many, ["__sl_key"]))
    best = F.struct(_distance()("consensus", "value").alias("d"), *([F.transform("rank", lambda r: -r)] if ranked else [-F.col("w"), F.col("value")]))
    pick = F.min_by(F.struct("value", (-F.element_at("rank", -1) if ranked else F.col("row_id")).alias("row_id")), best).alias("b")
    large = near.groupBy("least", "field", "consensus").agg(pick).select(F.col("least").alias("group_id"), "field", "consensus", "b.value", "b.row_id")
    return found.where("kind = 'done'").selectExpr(*wanted).unionByName(large)


def _distance():  # noqa: ANN202
    def distance(consensus: pa.Array, value: pa.Array) -> pa.Array:
        return pa.array([token_distance(a.split(), tokens_of(b)) for a, b in zip(consensus.to_pylist(), value.to_pylist(), strict=True)], pa.int32())

    return F.arrow_udf(distance, T.IntegerType())


def _merged(parts: DataFrame) -> DataFrame:
    """(key, least, consensus): the profiles of each large group aligned to each other; there is one for each of its salts."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            texts = []
            for profiles in x.column(x.schema.get_field_index("parts")).to_pylist():
                whole = Profile.loads(min(profiles))
                for p in sorted(profiles)[1:]:
                    whole.merge(Profile.loads(p))
                texts.append(" ".join(whole.consensus()))
            yield pa.RecordBatch.from_arrays([*[x.column(x.schema.get_field_index(k)) for k in ("__sl_key", "least")], pa.array(texts, pa.string())], names=["__sl_key", "least", "consensus"])

    grouped = parts.groupBy("__sl_key").agg(F.min("least").alias("least"), F.sum("n").alias("n"), F.collect_list("consensus").alias("parts")).where("n > 1")
    return grouped.drop("n").mapInArrow(merge, "__sl_key string, least bigint, consensus string")
