"""Subject areas of documents.

1. Each text is read once into word codes by sentence, written to the shared folder; the same pass counts
   in how many documents each hashed word stands.
2. Document vectors (signed feature hashing, weighted by rarity over the whole corpus, normalised)
   are clustered by bisecting k-means over all documents, in passes over the vectors in which all clusters due
   are split at once; every document is assigned to its nearest leaf.
3. A leaf is labelled by a mixture of subjects: first that of the labelled documents in it, then, from round
   to round, that of all its documents as their discriminative terms say. All hand labels are used; they are
   joined to their documents.
4. Discriminative terms (words and word pairs, hashed to a fixed number of buckets) are learnt in
   rounds over all documents: at first a term's subjects are the mixtures of the leaves and
   labels of its documents, then those of the *other* sentences of its documents. So a phrase
   that stands in documents of any subject (openings, small talk) stays without one, even if its words
   look like a subject's. A term counts as often as it stands in a sentence, in the evidence and in
   what is learnt; a sentence's probabilities of 0.01 or less are not learnt from. The rounds end when
   what is learnt no longer changes (more than by `settled`), or after `rounds`.
5. A sentence is about the subject with the strongest evidence of its terms, with the mixture of the
   document's leaf as prior, or about none; a subject counts for a document if at least `share` of its
   sentences about any subject are about it.

What reaches the driver is bounded by parameters: sums per term bucket and per cluster, the vectors of a small
corpus (at most `collected`). Sums are of whole numbers, so they don't depend on how documents are spread over tasks; they are made
by at most two tasks a core, whatever the number of files. Runs of five or more of one of = _ * ~ # - are breaks; an
unbroken run of 41 or more characters of the base64 alphabet with capitals, small letters and digits is encoded
data and holds no words; everything else is read, at any length. Where a script writes no blanks (Han, Kana,
Thai, Lao, Khmer, Burmese) the words are the pairs of neighbouring characters.

Defined results: null, empty and blank texts and texts about nothing give no row;
labels of unknown documents or subjects are left out; without any labels nothing has a subject;
repeated documents are judged alike; texts may be any length.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.operators.skew import bounded_broadcast
from sparkloom.session import written

# The blocks of the scripts that write no blanks.
_UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3041, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3134F))
_TAG = re.compile(r"""</?[A-Za-z][\w:-]*+(?:\s++[\w:@.-]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'<>=`]++))?+)*+\s*+/?>""")
_RULE = re.compile(r"([=_*~#-])\1{4,}")
_RULES = [c * 5 for c in "=_*~#-"]
_DATA = re.compile(r"(?<!\S)[A-Za-z0-9+/]{41,}={0,2}(?!\S)")
_UNSEEN = [*map(chr, range(0x200B, 0x2010)), "\u2060", "\ufeff", "\u00ad"]
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_ONE = float(1 << 16)  # sums are kept in 65536ths
_UNIT = 32767  # vectors that centres are fitted on are whole numbers of this part of one
_PACKED = 64  # vectors to a row
_TASKS = 256  # at most so many tasks give sums per cluster to the driver


@dataclass(frozen=True)
class Settings:
    """Parameters of the model; the defaults are those of production."""

    bits: int = 17  # of the number of term buckets
    dims: int = 64
    leaves: int = 48
    iterations: int = 8
    collected: int = 20_000  # documents up to which their vectors are clustered on the driver
    # By round, the last for all further rounds and the final judgement: cautious while little is known.
    rounds: int = 7
    settled: float = 0.002  # share of what is learnt that may still change when the rounds end
    smoothing: tuple[float, ...] = (2, 8, 4, 2, 1)
    least_gain: tuple[float, ...] = (0.2, 0.24, 0.24, 0.2, 0.14)  # share of the information on the subject from which a term counts, in full from 0.2 more
    evidence: tuple[float, ...] = (0.8, 1.2, 1.6, 2.0)  # log-odds a sentence needs to be about a subject, in units of log(number of subjects)
    certainty: tuple[float, ...] = (0.8, 0.8, 0.8, 0.7)
    leaf_weight: float = 0.25  # of a leaf's mixture where a document has no label
    prior_weight: float = 0.5  # of a leaf's mixture as prior of its documents' sentences; 0 leaves it out
    share: float = 0.25
    block: int = 1 << 17  # word codes handled at once
    seed: int = 7

    @property
    def buckets(self) -> int:
        return 1 << self.bits


def _clean(text: str) -> str:
    # What is rare is looked for in the cheapest way first.
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
        for c in _UNSEEN:
            if c in text:
                text = text.replace(c, "")
    for c in _RULES:
        if c in text:
            text = _RULE.sub("\n", text)
            break
    if len(max(text.split(), key=len, default="")) > 40:
        text = _DATA.sub(_without_data, text)
    return text


def _without_data(m: re.Match[str]) -> str:
    mixed = all(any(test(c) for c in m[0]) for test in (str.isdigit, str.isupper, str.islower))
    return " " if mixed else m[0]


_LETTER, _PAIRED, _JOINER, _BREAK, _ENDER, _CLOSER, _SPACE, _QUOTE = 1, 2, 3, 4, 5, 6, 7, 8
_KINDS = {c: _JOINER for c in "’-"} | {c: _BREAK for c in "\0\r\n。；"} | {c: _ENDER for c in ".!?…;"} | {c: _CLOSER for c in '"”»)]'} | {"'": _QUOTE}
_POWERS = np.cumprod(np.full(64, _A))


def _kind(c: str) -> int:
    if any(a <= ord(c) <= b for a, b in _UNSPACED):
        return _PAIRED if c not in "\u30fb\u30a0" else 0
    return _KINDS.get(c, _LETTER if c.isalpha() else _SPACE if c.isspace() else 0)


class Coder:
    """Texts to word codes, by arrays of characters; what a character is gets looked up once.

    A word is a run of letters, also joined by single apostrophes or hyphens, or a pair of neighbouring
    characters of a script without blanks. A sentence ends at a full stop and the like before white space, or at
    a line break.
    """

    def __init__(self, most: int = 1 << 17) -> None:
        self.kinds, self.most = np.full(0x110000, 255, np.uint8), most

    def words(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of clean texts joined by NUL: where each word starts and ends, its code, and how many breaks stand before it."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.kinds[codes]
        if (new := np.unique(codes[kind == 255])).size:
            self.kinds[new] = [_kind(chr(c)) for c in new]
            kind = self.kinds[codes]
        edge = np.zeros(1, bool)
        letter = kind == _LETTER
        inside = letter.copy()
        inside[1:-1] |= ((kind == _JOINER) | (kind == _QUOTE))[1:-1] & letter[:-2] & letter[2:]
        change = np.flatnonzero(np.diff(np.concatenate([edge, inside, edge]).view(np.int8)))
        start, end = change[::2], change[1::2]
        if (paired := kind == _PAIRED).any():
            change = np.flatnonzero(np.diff(np.concatenate([edge, paired, edge]).view(np.int8)))
            first, last = change[::2], change[1::2]
            two = np.flatnonzero(paired[:-1] & paired[1:])
            one = first[last - first == 1]
            start = np.concatenate([start, two, one])
            end = np.concatenate([end, two + 2, one + 1])
            order = np.argsort(start, kind="stable")
            start, end = start[order], end[order]
        stop = kind == _BREAK
        enders = np.flatnonzero(kind == _ENDER)
        if len(enders):
            after = enders + 1
            while True:  # over the closing marks, of which there are few
                at = np.minimum(after, len(kind) - 1)
                more = (after < len(kind)) & ((kind[at] == _CLOSER) | (kind[at] == _QUOTE))
                if not more.any():
                    break
                after = after + more
            next_, one_on = kind[np.minimum(after, len(kind) - 1)], kind[np.minimum(enders + 1, len(kind) - 1)]
            loud = (codes[enders] == ord("!")) | (codes[enders] == ord("?"))
            stop[enders[(after >= len(kind)) | (next_ == _SPACE) | (next_ == _BREAK) | (loud & (one_on == _PAIRED))]] = True
        return start, end, self._hashed(codes, start, end), np.cumsum(stop)[start] if len(start) else np.zeros(0, np.int64)

    @staticmethod
    def _hashed(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A number for each word by its characters and their places."""
        if not len(start):
            return np.zeros(0, np.int32)
        size = end - start
        first = np.cumsum(size) - size
        place = np.arange(size.sum()) - np.repeat(first, size)
        powers = _POWERS if size.max() <= len(_POWERS) else np.cumprod(np.full(int(size.max()), _A))
        h = np.add.reduceat(codes[np.repeat(start, size) + place] * powers[place], first)
        return ((h ^ (h >> np.uint64(29))) * _B >> np.uint64(32)).astype(np.uint32).view(np.int32)

    def codes(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Codes of all words, how many each sentence has, how many words and how many sentences each text has."""
        parts, at = [], 0
        clean = [_clean(t) if t else "" for t in texts]
        while at < len(clean):
            to, size = at, 0
            while to < len(clean) and (to == at or size + len(clean[to]) <= self.most):
                size += len(clean[to]) + 1
                to += 1
            joined = "\0".join(t.replace("\0", " ") if "\0" in t else t for t in clean[at:to]).lower()
            start, _, code, breaks = self.words(joined)
            ends = np.flatnonzero(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32) == 0)
            text = np.searchsorted(ends, start)
            first = np.flatnonzero(np.diff(breaks, prepend=-1))
            parts.append((code, np.diff(np.append(first, len(start))), np.bincount(text, minlength=to - at), np.bincount(text[first], minlength=to - at)))
            at = to
        empty = np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (empty.astype(np.int32), empty, empty, empty)


def words_of(text: str) -> list[str]:
    """The words of a text, in order."""
    text = _clean(text).replace("\0", " ").lower()
    return [text[a:b] for a, b in zip(*Coder().words(text)[:2], strict=True)]


def bucket_of(codes: np.ndarray, bits: int) -> np.ndarray:
    """The term bucket of each word code."""
    return ((codes.astype(np.int64).astype(np.uint64) * _A) >> np.uint64(64 - bits)).astype(np.int64)


def label_votes(labels: DataFrame, key: str, subject: str, subjects: list[str]) -> DataFrame:
    """(key, votes): of each labelled document its votes by subject; every annotator's label is a vote."""
    known = labels.where(F.col(key).isNotNull() & F.col(subject).isin(subjects))
    return known.groupBy(key).agg(F.array(*[F.count_if(F.col(subject) == x).cast("int") for x in subjects]).alias("votes"))


def with_votes(docs: DataFrame, labels: DataFrame, key: str, subject: str, subjects: list[str]) -> DataFrame:
    """The documents with the votes of their labels; null without any."""
    if not subjects:
        return docs.withColumn("votes", F.lit(None).cast("array<int>"))
    votes = written(label_votes(labels, key, subject, subjects))
    return docs.join(bounded_broadcast(votes, votes.count(), 4 * len(subjects) + 64), key, "left")


def coded_documents(docs: DataFrame, key: str, text: str, s: Settings) -> tuple[DataFrame, np.ndarray, int]:
    """(key, words, sizes, votes) of each document, written to the shared folder; in how many documents each word bucket stands; how many documents."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, words array<int>, sizes array<int>, votes array<int>, slots array<int>, counts array<bigint>, docs bigint"

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, seen, n, of_key = Coder(), np.zeros(s.buckets, np.int64), 0, None
        ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())

        def batch(keys: pa.Array, *columns: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([keys, *columns], names=[key, "words", "sizes", "votes", "slots", "counts", "docs"])

        def lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
            return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), values.astype(np.int32))

        for b in batches:
            keys, of_key = b.column(b.schema.get_field_index(key)), b.schema.field(key).type
            texts = [None if t is None else t.decode("utf-8", "replace") for t in b.column(b.schema.get_field_index(text)).cast(pa.binary()).to_pylist()]
            codes, sizes, words, sentences = coder.codes(texts)
            own = np.unique((np.repeat(np.arange(len(texts)), words) << s.bits) | bucket_of(codes, s.bits))
            seen += np.bincount(own & (s.buckets - 1), minlength=s.buckets)
            n += len(texts)
            yield batch(keys, lists(codes, words), lists(sizes, sentences), b.column(b.schema.get_field_index("votes")).cast(ints), pa.nulls(len(texts), ints), pa.nulls(len(texts), longs), pa.nulls(len(texts), pa.int64()))
        if n:  # one row more a task: what it has counted
            some = np.flatnonzero(seen)
            yield batch(pa.nulls(1, of_key), pa.nulls(1, ints), pa.nulls(1, ints), pa.nulls(1, ints), pa.array([some.astype(np.int32)], ints), pa.array([seen[some]], longs), pa.array([n]))

    both = written(docs.select(key, text, "votes").mapInArrow(convert, schema))
    counted = both.where(F.col("docs").isNotNull())
    sums = counted.select(F.explode(F.arrays_zip("slots", "counts")).alias("x")).groupBy("x.slots").agg(F.sum("x.counts").alias("n")).toArrow()
    present = np.zeros(s.buckets, np.int64)
    if sums.num_rows:
        present[sums["slots"].to_numpy()] = sums["n"].to_numpy()
    return both.where(F.col("docs").isNull()).select(key, "words", "sizes", "votes"), present, int(counted.agg(F.sum("docs")).first()[0] or 0)


class Block:
    """Some documents as flat arrays: words by sentence, sentences by document; word pairs are made when asked for."""

    def __init__(self, keys: list, codes: np.ndarray, sizes: np.ndarray, per_doc: np.ndarray, bits: int, labelled: np.ndarray | None = None, votes: np.ndarray | None = None) -> None:
        self.keys, self.sizes, self.bits = keys, sizes, bits
        self.labelled, self.votes = labelled, votes  # which documents have labels, and their votes by subject
        self.codes = codes.astype(np.int64).astype(np.uint64)
        self.sentence_doc = np.repeat(np.arange(len(keys)), per_doc)
        self.sentence = np.repeat(np.arange(len(sizes)), sizes)
        self.words = bucket_of(codes, bits)

    @property
    def n_docs(self) -> int:
        return len(self.keys)

    @cached_property
    def word_doc(self) -> np.ndarray:
        return self.sentence_doc[self.sentence]

    @cached_property
    def terms(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Buckets, their sentences and how many each sentence has: of single words and of pairs of neighbours."""
        same = np.flatnonzero(self.sentence[1:] == self.sentence[:-1])
        pair = ((self.codes[same] * _A + self.codes[same + 1] * _B) >> np.uint64(64 - self.bits)).astype(np.int64)
        return [(self.words, self.sentence, self.sizes), (pair, self.sentence[same], np.maximum(self.sizes - 1, 0))]

    def sentence_sums(self, table: np.ndarray, telling: np.ndarray) -> np.ndarray:
        """For each sentence the sum of the table's rows of its terms; `telling` marks the rows that aren't 0."""
        out = np.zeros((len(self.sizes), table.shape[1]), np.float32)
        for bucket, owner, _ in self.terms:
            some = telling[bucket]
            bucket, owner = bucket[some], owner[some]
            if len(bucket):
                first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                out[owner[first]] += np.add.reduceat(table[bucket], first, axis=0)
        return out

    def labels(self, width: int) -> np.ndarray:
        """The share of each subject in a document's votes; zeros without labels."""
        own = np.zeros((self.n_docs, width))
        if len(self.labelled):
            own[self.labelled] = self.votes / self.votes.sum(axis=1, keepdims=True)
        return own

    def document_sums(self, values: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.sentence_doc, weights=values[:, k], minlength=self.n_docs) for k in range(values.shape[1])], axis=1)

    def spread(self, values: np.ndarray, least: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
        """Each sentence's values over `least`, given to all its terms: (bucket x width + column, value)."""
        at, column = np.nonzero(values > least)
        value, slots, weights = values[at, column], [], []
        for bucket, _, size in self.terms:
            start = np.cumsum(size) - size
            n = size[at]
            rows = np.arange(n.sum()) + np.repeat(start[at] - (np.cumsum(n) - n), n)
            slots.append(bucket[rows] * values.shape[1] + np.repeat(column, n))
            weights.append(np.repeat(value, n))
        return np.concatenate(slots), np.concatenate(weights)


def blocks(batch: pa.RecordBatch, key: str, s: Settings) -> Iterator[Block]:
    """A batch of coded documents in blocks of about s.block words."""
    words, sizes = (batch.column(batch.schema.get_field_index(c)) for c in ("words", "sizes"))
    keys = batch.column(batch.schema.get_field_index(key)).to_pylist()
    w_at, s_at = words.offsets.to_numpy().astype(np.int64), sizes.offsets.to_numpy().astype(np.int64)
    w_all, s_all = words.values.to_numpy(zero_copy_only=False), sizes.values.to_numpy(zero_copy_only=False)
    votes = batch.column(batch.schema.get_field_index("votes"))
    labelled = np.flatnonzero(votes.is_valid().to_numpy(zero_copy_only=False))
    of_label = votes.flatten().to_numpy(zero_copy_only=False).reshape(len(labelled), -1) if len(labelled) else np.zeros((0, 0))
    at = 0
    while at < len(keys):
        to = max(at + 1, int(np.searchsorted(w_at, w_at[at] + s.block, side="right")) - 1)
        a, b = np.searchsorted(labelled, [at, to])
        yield Block(keys[at:to], w_all[w_at[at] : w_at[to]], s_all[s_at[at] : s_at[to]].astype(np.int64), np.diff(s_at[at : to + 1]), s.bits, labelled[a:b] - at, of_label[a:b])
        at = to


def _sums(coded: DataFrame, key: str, size: int, s: Settings, each: Callable[[Block], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Sums over all documents of what `each` gives for a block, (slot, number): an array of `size` numbers.

    Numbers are rounded to 65536ths and summed as whole numbers. Each task adds up its own documents and gives
    its slots that aren't 0; there are at most two tasks a core.
    """

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for block in blocks(batch, key, s):
                at, values = each(block)
                total += np.bincount(at, weights=np.rint(values * _ONE), minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some].astype(np.int64))], names=["slot", "value"])

    few = coded.coalesce(2 * coded.sparkSession.sparkContext.defaultParallelism)
    rows = few.mapInArrow(convert, "slot int, value bigint").groupBy("slot").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(size)
    if rows.num_rows:
        out[rows["slot"].to_numpy()] = rows["value"].to_numpy() / _ONE
    return out


def document_vectors(block: Block, rarity: np.ndarray, s: Settings) -> np.ndarray:
    """Normalised signed hashes of the words' rarity weights."""
    sign = np.where((block.words >> 6) & 1, 1.0, -1.0) * rarity[block.words]
    flat = np.bincount(block.word_doc * s.dims + block.words % s.dims, weights=sign, minlength=block.n_docs * s.dims)
    v = flat.reshape(block.n_docs, s.dims)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def leaf_of(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest leaf centre of each vector."""
    return np.argmin((centres**2).sum(axis=1) - 2 * vectors @ centres.T, axis=1)


def bisecting_centres(vectors: np.ndarray, leaves: int, iterations: int) -> np.ndarray:
    """Centres of a bisecting k-means: the cluster with the largest spread is split in two until there are `leaves`, or none can be split."""

    def spread(rows: np.ndarray) -> float:
        return float(((vectors[rows] - vectors[rows].mean(axis=0)) ** 2).sum())

    def halves(rows: np.ndarray) -> np.ndarray:
        x = vectors[rows]
        first = x[np.argmax(((x - x.mean(axis=0)) ** 2).sum(axis=1))]
        pair = np.stack([first, x[np.argmax(((x - first) ** 2).sum(axis=1))]])
        for _ in range(iterations):
            side = leaf_of(x, pair)
            if side.all() or not side.any():
                break
            pair = np.stack([x[side == k].mean(axis=0) for k in (0, 1)])
        return side

    if not len(vectors):
        return np.zeros((1, vectors.shape[1]))
    clusters = [(spread(np.arange(len(vectors))), np.arange(len(vectors)))]
    while len(clusters) < leaves:
        k = max(range(len(clusters)), key=lambda i: clusters[i][0])
        worst, rows = clusters[k]
        if worst <= 1e-9:
            break
        side = halves(rows)
        parts = [rows[side == i] for i in (0, 1)]
        clusters[k : k + 1] = [(spread(part) if all(map(len, parts)) else 0.0, part) for part in parts if len(part)]
    return np.stack([vectors[rows].mean(axis=0) for _, rows in clusters])


def packed_vectors(coded: DataFrame, key: str, rarity: np.ndarray, s: Settings) -> DataFrame:
    """(n, v): the vectors of all documents with words, as whole numbers, many to a row; written to the shared folder."""
    shared = coded.sparkSession.sparkContext.broadcast(rarity)

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch, key, s):
                v = np.rint(document_vectors(b, shared.value, s) * _UNIT).astype("<i2")
                v = v[v.any(axis=1)]
                rows = [v[i : i + _PACKED] for i in range(0, len(v), _PACKED)]
                yield pa.RecordBatch.from_arrays([pa.array(map(len, rows), pa.int64()), pa.array([r.tobytes() for r in rows], pa.binary())], names=["n", "v"])

    return written(coded.mapInArrow(convert, "n bigint, v binary"))


@dataclass
class Cluster:
    """A cluster of the tree by the sums over its vectors; split once `parts` are known."""

    n: int
    sums: np.ndarray
    squares: int
    whole: bool = False  # can't be split
    pair: np.ndarray | None = None  # the two centres that split it
    parts: list[Cluster] | None = None

    @property
    def mean(self) -> np.ndarray:
        return self.sums / self.n

    @property
    def spread(self) -> float:
        return 0.0 if self.whole else max(0.0, self.squares - float((self.sums.astype(float) ** 2).sum()) / self.n) / _UNIT**2


class Tree:
    """The splits on the way down to the chosen clusters, as arrays."""

    def __init__(self, root: Cluster, chosen: list[Cluster]) -> None:
        place, pairs, below, out = {id(c): ~i for i, c in enumerate(chosen)}, [], [], ~len(chosen)

        def down(c: Cluster) -> int:
            if id(c) in place or c.parts is None:
                return place.get(id(c), out)
            first, second = map(down, c.parts)
            if first == second == out:
                return out
            pairs.append(c.pair)
            below.append([first, second])
            return len(pairs) - 1

        self.root, self.out = down(root), len(chosen)
        self.pairs, self.below = np.array(pairs), np.array(below)

    def chosen(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The vectors in chosen clusters, and their clusters."""
        at = np.full(len(x), self.root)
        if self.root >= 0:
            second = nearer_second(x, self.pairs)
            while len(rows := np.flatnonzero(at >= 0)):
                at[rows] = self.below[at[rows], second[rows, at[rows]].astype(int)]
        some = ~at != self.out
        return (x, ~at) if some.all() else (x[some], ~at[some])


def nearer_second(x: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Vectors x pairs: whether a vector is nearer to the second centre of a pair."""
    return x @ (pairs[:, 1] - pairs[:, 0]).T > ((pairs[:, 1] ** 2).sum(axis=1) - (pairs[:, 0] ** 2).sum(axis=1)) / 2


def _folded(packed: DataFrame, dims: int, start: np.ndarray, each: Callable[[np.ndarray, np.ndarray], None]) -> np.ndarray:
    """tasks x shape of `start`: what each task makes of `start` by each(out, vectors)."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = start.copy()
        for batch in batches:
            for i in range(0, batch.num_rows, _PACKED):
                each(out, np.frombuffer(b"".join(batch.column(0).slice(i, _PACKED).to_pylist()), "<i2").reshape(-1, dims).astype(float))
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["out"])

    context = packed.sparkSession.sparkContext
    rows = packed.select("v").coalesce(min(_TASKS, 2 * context.defaultParallelism)).mapInArrow(convert, "out binary").toArrow()["out"].to_pylist()
    return np.stack([start, *(np.frombuffer(r, start.dtype).reshape(start.shape) for r in rows)])


def _farthest(packed: DataFrame, tree: Tree, points: np.ndarray) -> np.ndarray:
    """Of each chosen cluster the vector farthest from its point; of equals the last in the order of their numbers."""
    width = points.shape[1]

    def best(out: np.ndarray, of: np.ndarray, far: np.ndarray, x: np.ndarray) -> None:
        top = out[:, 0].copy()
        np.maximum.at(top, of, far)
        some = far == top[of]
        for row in np.unique(np.column_stack([of[some], far[some], x[some]]), axis=0):
            k = int(row[0])
            if tuple(row[1:]) > tuple(out[k]):
                out[k] = row[1:]

    def each(out: np.ndarray, x: np.ndarray) -> None:
        x, of = tree.chosen(x)
        best(out, of, np.rint(np.einsum("ij,ij->i", x, x) - 2 * (x @ points.T)[np.arange(len(x)), of] + (points**2).sum(axis=1)[of]), x)

    out = np.full((len(points), 1 + width), -1.0)
    for task in _folded(packed, width, out.copy(), each):
        best(out, np.arange(len(points)), task[:, 0], task[:, 1:])
    return out[:, 1:]


def _halved(packed: DataFrame, tree: Tree, pairs: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """Sums (number, squares, vectors) over the two parts of each chosen cluster by the nearer centre of its pair; with `before` how they change from those by the pairs before."""
    width = pairs.shape[2]

    def each(out: np.ndarray, x: np.ndarray) -> None:
        x, of = tree.chosen(x)
        at = np.arange(len(x))
        part, sign = 2 * of + nearer_second(x, pairs)[at, of], np.ones(len(x))
        if before is not None:  # only vectors that change sides
            last = 2 * of + nearer_second(x, before)[at, of]
            moved = np.flatnonzero(part != last)
            part, at, sign = np.concatenate([part[moved], last[moved]]), np.tile(moved, 2), np.repeat([1.0, -1.0], len(moved))
        if not len(at):
            return
        order = np.argsort(part, kind="stable")
        part, sign, x = part[order], sign[order], x[at[order]]
        first = np.flatnonzero(np.diff(part, prepend=-1))
        rows = np.column_stack([np.ones(len(x)), np.einsum("ij,ij->i", x, x), x]) * sign[:, None]
        out[part[first]] += np.add.reduceat(rows, first, axis=0).astype(np.int64)

    return _folded(packed, width, np.zeros((2 * len(pairs), 2 + width), np.int64), each).sum(axis=0).reshape(-1, 2, 2 + width)


def _split(packed: DataFrame, root: Cluster, chosen: list[Cluster], iterations: int) -> None:
    """The chosen leaves split in two, all in the same passes."""
    tree = Tree(root, chosen)
    first = _farthest(packed, tree, np.stack([c.mean for c in chosen]))
    pairs, before, sums = np.stack([first, _farthest(packed, tree, first)], axis=1), None, 0
    for _ in range(iterations):
        sums = sums + _halved(packed, tree, pairs, before)
        before = pairs.copy()
        for i, c in enumerate(chosen):
            parts = [Cluster(int(r[0]), r[2:], int(r[1])) for r in sums[i]]
            c.whole = c.whole or not all(part.n for part in parts)
            if not c.whole:
                c.pair, c.parts, pairs[i] = before[i], parts, [part.mean for part in parts]
        if (pairs == before).all():
            break


def corpus_centres(packed: DataFrame, s: Settings) -> np.ndarray:
    """Centres of the bisecting k-means of `bisecting_centres` over all vectors, in passes over them.

    How a cluster is split doesn't depend on the others, so all clusters that may be next are split in the same passes.
    """
    n = int(packed.agg(F.sum("n")).first()[0] or 0)
    if n <= s.collected:
        x = np.frombuffer(b"".join(packed.select("v").toArrow()["v"].to_pylist()), "<i2").reshape(-1, s.dims)
        return bisecting_centres(x[np.lexsort(x.T[::-1])[::-1]] / _UNIT, s.leaves, s.iterations)
    every = Cluster(n, np.zeros(s.dims), 0)
    sums = _halved(packed, Tree(every, [every]), np.zeros((1, 2, s.dims)))[0, 0]
    root = Cluster(int(sums[0]), sums[2:], int(sums[1]))
    while True:
        leaves = [root]
        while len(leaves) < s.leaves:
            k = max(range(len(leaves)), key=lambda i: leaves[i].spread)
            if leaves[k].parts is None or leaves[k].spread <= 1e-9:
                break
            leaves[k : k + 1] = leaves[k].parts
        # No more than the clusters of the largest spread, as many as are still wanted, can be next.
        next_ = sorted(range(len(leaves)), key=lambda i: -leaves[i].spread)[: s.leaves - len(leaves)]
        chosen = [leaves[i] for i in next_ if leaves[i].parts is None and leaves[i].spread > 1e-9]
        if not chosen or leaves[next_[0]].spread <= 1e-9:
            return np.stack([c.mean for c in leaves]) / _UNIT
        _split(packed, root, chosen, s.iterations)


@dataclass
class Model:
    """All that judging a document needs; its size is fixed by the settings."""

    subjects: list[str]
    terms: np.ndarray  # buckets x subjects: log-odds times how telling the term is
    rarity: np.ndarray
    centres: np.ndarray
    mixture: np.ndarray  # leaves x subjects
    settings: Settings
    round: int = -1

    def leaf(self, block: Block) -> np.ndarray:
        return leaf_of(document_vectors(block, self.rarity, self.settings), self.centres)

    @cached_property
    def telling(self) -> np.ndarray:
        return self.terms.any(axis=1)

    def judge(self, block: Block, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each sentence its subjects' probabilities, and whether it is about any subject."""
        score = block.sentence_sums(self.terms, self.telling)
        prior = self.settings.prior_weight * np.log(self.mixture * len(self.subjects))
        odds = np.minimum(score, 50) + prior.astype(np.float32)[leaf][block.sentence_doc]
        p = np.exp(odds - odds.max(axis=1, keepdims=True, initial=-np.inf))
        p /= p.sum(axis=1, keepdims=True)
        return p, (score.max(axis=1, initial=0) > at_round(self.settings.evidence, self.round) * information(len(self.subjects))) & (p.max(axis=1, initial=0) > at_round(self.settings.certainty, self.round))


def at_round(values: tuple[float, ...], n: int) -> float:
    return values[n] if 0 <= n < len(values) else values[-1]


def information(subjects: int) -> float:
    """Nats that a subject is worth."""
    return float(np.log(max(2, subjects)))


def discriminative_terms(counts: np.ndarray, smoothing: float, least_gain: float) -> np.ndarray:
    """Log-odds of the subjects of each term, weighted by how much the term tells of the subject."""
    n, width = counts.sum(axis=1), counts.shape[1]
    prior = (counts.sum(axis=0) + 1) / (counts.sum() + width)
    p = (counts + smoothing * prior) / (n + smoothing)[:, None]
    odds = np.log(p / prior)
    gain = (p * odds).sum(axis=1) / information(width)
    return (odds * np.clip((gain - least_gain) / 0.2, 0, 1)[:, None]).astype(np.float32)


def fit(coded: DataFrame, present: np.ndarray, n_docs: int, subjects: list[str], key: str, s: Settings) -> Model:
    """The model of a corpus; see the steps at the top of the module."""
    context, width = coded.sparkSession.sparkContext, len(subjects)
    rarity = np.log((n_docs + 1) / (present + 1))
    centres = corpus_centres(packed_vectors(coded, key, rarity, s), s)
    uniform = np.full((len(centres), width), 1 / max(1, width))

    def mixture(found: np.ndarray) -> np.ndarray:
        return (found + uniform) / (found.sum(axis=1, keepdims=True) + 1)

    place = context.broadcast((rarity, centres))

    def of_leaf(b: Block) -> tuple[np.ndarray, np.ndarray]:
        weights, middles = place.value
        leaf = leaf_of(document_vectors(b, weights, s), middles)
        return (leaf[:, None] * width + np.arange(width)).ravel(), b.labels(width).ravel()

    by_label = _sums(coded.where(F.col("votes").isNotNull()), key, uniform.size, s, of_leaf).reshape(uniform.shape) if width else uniform
    model = Model(subjects, np.zeros((s.buckets, width), np.float32), rarity, centres, mixture(by_label), s)
    last = None

    for n in range(s.rounds if width else 0):
        shared = context.broadcast(model)

        def contexts(b: Block, n: int = n, shared=shared) -> tuple[np.ndarray, np.ndarray]:  # noqa: ANN001
            m = shared.value
            leaf = m.leaf(b)
            if n == 0:  # labels, else the subjects that the leaf clearly leans to
                own = b.labels(width)
                lean = np.maximum(m.mixture - 2 / width, 0)[leaf]
                base, found = np.where(own.sum(axis=1, keepdims=True) > 0, own, s.leaf_weight * lean)[b.sentence_doc], own
            else:  # what the other sentences of the document are about
                p, about = m.judge(b, leaf)
                p = np.where(about[:, None], p, 0)
                found = b.document_sums(p)
                others = np.maximum(found[b.sentence_doc] - p, 0)
                size = others.sum(axis=1, keepdims=True)
                base = np.where(size > 0.01, others / np.maximum(size, 0.01), 0)
                if n == 1:
                    own = b.labels(width)[b.sentence_doc]
                    base = np.where(own.sum(axis=1, keepdims=True) > 0, 0.5 * base + 0.5 * own, base)
            at, value = b.spread(base)
            leaves = ((s.buckets + leaf)[:, None] * width + np.arange(width)).ravel()
            return np.concatenate([at, leaves]), np.concatenate([value, found.ravel()])

        sums = _sums(coded, key, (s.buckets + len(centres)) * width, s, contexts).reshape(-1, width)
        counts, found = sums[: s.buckets], sums[s.buckets :]
        settled = n > 1 and np.abs(counts - last).sum() <= s.settled * counts.sum()
        n = -1 if settled else n  # then with the last settings at once
        model = replace(model, terms=discriminative_terms(counts, at_round(s.smoothing, n), at_round(s.least_gain, n)), mixture=mixture(found), round=n)
        shared.unpersist()
        if settled:
            break
        last = counts
    return replace(model, round=-1)


def assign(coded: DataFrame, model: Model, key: str, subject: str = "subject") -> DataFrame:
    """(key, subject, sentences, about): each subject of a document, with how many of its `about` sentences are about it."""
    shared, kind = coded.sparkSession.sparkContext.broadcast(model), coded.schema[key].dataType.simpleString()

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for b in blocks(batch, key, m.settings):
                p, about = m.judge(b, m.leaf(b))
                counts = b.document_sums(np.where(about[:, None], np.eye(len(m.subjects))[p.argmax(axis=1)], 0))
                size = counts.sum(axis=1)
                doc, k = np.nonzero((counts > 0) & (counts >= m.settings.share * size[:, None]))
                keys = pa.array(b.keys, batch.schema.field(key).type).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array([m.subjects[i] for i in k], pa.string()), pa.array(counts[doc, k].astype(np.int64)), pa.array(size[doc].astype(np.int64))], names=[key, subject, "sentences", "about"]
                )

    made = coded if model.subjects else coded.limit(0)
    return made.mapInArrow(convert, f"{key} {kind}, {subject} string, sentences bigint, about bigint")


def fitted(docs: DataFrame, labels: DataFrame, subjects: DataFrame, key: str = "doc_id", text: str = "text", subject: str = "subject", settings: Settings | None = None) -> tuple[DataFrame, Model]:
    """The coded documents and the model fitted to them; `subjects` lists the few that there are."""
    s = settings or Settings()
    names = sorted({r[0] for r in subjects.select(subject).where(F.col(subject).isNotNull()).distinct().collect()})
    coded, present, n_docs = coded_documents(with_votes(docs.select(key, text), labels, key, subject, names), key, text, s)
    return coded, fit(coded, present, n_docs, names, key, s)


def subjects_of(docs: DataFrame, labels: DataFrame, subjects: DataFrame, key: str = "doc_id", text: str = "text", subject: str = "subject", settings: Settings | None = None) -> DataFrame:
    """Every subject of every document."""
    coded, model = fitted(docs, labels, subjects, key, text, subject, settings)
    return assign(coded, model, key, subject)


def leaf_report(docs: DataFrame, model: Model, text: str = "text", most: int = 8) -> DataFrame:
    """(leaf, documents, subject, share, terms): each leaf with its most discriminative words and the subject its mixture leans to.

    Words are counted once a document, over all documents; a word's weight in a leaf is n log(n / expected).
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, coder = shared.value, Coder()
        for batch in batches:
            found: dict[tuple[int, str], int] = {}
            for t in batch.column(0).cast(pa.binary()).to_pylist():
                clean = "" if t is None else _clean(t.decode("utf-8", "replace")).replace("\0", " ").lower()
                start, end, codes, breaks = coder.words(clean)
                if len(codes):
                    sizes = np.unique(breaks, return_counts=True)[1]
                    leaf = int(m.leaf(Block([0], codes, sizes, np.array([len(sizes)]), m.settings.bits))[0])
                    for w in {clean[a:b] for a, b in zip(start, end, strict=True)} | {""}:
                        found[leaf, w] = found.get((leaf, w), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([w for _, w in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["leaf", "word", "n"])

    spark = docs.sparkSession
    counts = written(docs.select(text).mapInArrow(convert, "leaf int, word string, n bigint").groupBy("leaf", "word").agg(F.sum("n").alias("n")))
    sizes = counts.where("word = ''").select("leaf", F.col("n").alias("documents"))
    every = sizes.agg(F.sum("documents").alias("every"))
    of_word = counts.where("word <> ''").groupBy("word").agg(F.sum("n").alias("in_all"))
    scored = counts.where("word <> ''").join(of_word, "word").join(F.broadcast(sizes), "leaf").crossJoin(F.broadcast(every))
    scored = scored.withColumn("weight", F.col("n") * F.log(F.col("n") * F.col("every") / (F.col("documents") * F.col("in_all"))))
    ranked = scored.withColumn("rn", F.row_number().over(Window.partitionBy("leaf").orderBy(F.desc("weight"), "word"))).where(F.col("rn") <= most)  # cut in each task before the shuffle
    terms = ranked.groupBy("leaf", "documents").agg(F.array_sort(F.collect_list(F.struct("rn", "word"))).alias("t"))
    mixtures = [(i, model.subjects[int(row.argmax())], float(row.max())) for i, row in enumerate(model.mixture) if len(row)]
    named = spark.createDataFrame(mixtures, "leaf int, subject string, share double")
    return terms.join(F.broadcast(named), "leaf", "left").select("leaf", "documents", "subject", "share", F.transform("t", lambda x: x["word"]).alias("terms"))
