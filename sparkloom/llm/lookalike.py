"""Texts that look the same in different characters, brought to one form.

Look-alike classes over code points and strings come from Unicode compatibility forms, from the
public look-alike data of ICU (part of every Spark distribution) and a few fixed pairs; union-find
closes them transitively. Each class is represented by its member that is most frequent in the
reference names. Texts are decomposed, rewritten greedily (leftmost, longest) by a multi-pattern
automaton, and compared in that form. Classes never join two different plain letters or digits,
so letter case, accents and 1/l/I or 0/O stay apart.

Defined results: null and blank texts have no form; invisible characters vanish, every kind of
blank is a space; texts may be any length; repeated rows give repeated results; a row that differs
from a name only by plain spaces, tabs or line breaks at its ends or repeated is no case.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from sparkloom.operators.skew import bounded_broadcast, hot_keys, salted_join

# Look-alikes that the ICU data lacks or gives another reading.
EXTRA_PAIRS = (("ӏ", "l"), ("ı", "ı"), ("∕", "/"), ("－", "-"), ("（", "("), ("）", ")"), ("＆", "&"))
# Characters that show nothing although they are not of the format category.
INVISIBLE = {"͏", "ᅟ", "ᅠ", "឴", "឵", "᠋", "᠌", "᠍", "᠎", "ㅤ", "ﾠ", *map(chr, range(0xFE00, 0xFE10))}
BLANK = {"⠀", "\u0085", " ", " "}
#: Compatibility forms that keep the look; super- and subscripts, fractions and squares don't.
SAME_LOOK = ("<font>", "<wide>", "<narrow>", "<compat>", "<noBreak>")
_PLAIN = re.compile(r"[ \t\r\n\f\v]+")


class UnionFind:
    """Disjoint classes of strings; a union that would join two different anchors is refused."""

    def __init__(self, anchors: Iterable[str]) -> None:
        self.parent: dict[str, str] = {}
        self.anchor: dict[str, str] = {a: a for a in anchors}

    def find(self, x: str) -> str:
        root = x
        while (up := self.parent.setdefault(root, root)) != root:
            root = up
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def union(self, a: str, b: str) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return True
        x, y = self.anchor.get(a), self.anchor.get(b)
        if x and y and x != y:
            return False
        self.parent[b] = a
        if y:
            self.anchor[a] = y
        return True

    def classes(self) -> Iterable[list[str]]:
        by = defaultdict(list)
        for x in self.parent:
            by[self.find(x)].append(x)
        return by.values()


def _assigned() -> Iterator[int]:
    """All code points that can stand for a character: the planes in use, without the private ones."""
    for first, last in ((0, 0xDFFF), (0xF900, 0x33FFF), (0xE0000, 0xE01FF)):
        yield from (i for i in range(first, last + 1) if not 0xD800 <= i <= 0xDFFF)


def _icu_skeletons(spark: SparkSession, chars: list[str]) -> dict[str, str]:
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    return dict(zip(chars, checker.getSkeleton("\n".join(chars)).split("\n"), strict=True))


def lookalike_pairs(spark: SparkSession) -> Iterator[tuple[str, str]]:
    """(code point, string that looks the same), over all of Unicode; a bounded, fixed set."""
    plain = [chr(c) for c in range(0x21, 0x7F)]
    chars = [c for i in _assigned() if i > 0x20 and (c := chr(i)) not in INVISIBLE and unicodedata.category(c)[0] not in "CMZ"]
    skeleton = _icu_skeletons(spark, chars)
    plain_of = defaultdict(list)
    for c in plain:
        plain_of[skeleton[c]].append(c)
    yield from EXTRA_PAIRS
    given = {a for a, _ in EXTRA_PAIRS}
    for c in chars:
        if c.isascii() or c in given:
            continue
        kind = unicodedata.decomposition(c).partition(" ")[0]
        if kind in SAME_LOOK:
            yield c, unicodedata.normalize("NFKD", c)
        elif not kind or kind[0] == "<":
            look = skeleton[c]
            if look in plain_of:  # several plain characters share some looks: take the one of the same kind
                same = [p for p in plain_of[look] if unicodedata.category(p) == unicodedata.category(c)]
                look = same[0] if same else plain_of[look][0] if len(plain_of[look]) == 1 else ""
            if look and look != c:
                yield c, look


def rewrite_rules(spark: SparkSession, names: Counter[str]) -> dict[str, str]:
    """Pattern -> representative, the most frequent member of its class among the characters of the names."""
    classes = UnionFind(anchors=[chr(c) for c in range(0x21, 0x7F)])
    for a, b in lookalike_pairs(spark):
        if a != b:
            classes.union(b, a)
    rules = {}
    for members in classes.classes():
        if len(members) > 1:
            best = min(members, key=lambda m: (-names[m], not m.isascii(), len(m), m))
            rules |= {m: best for m in members if m != best and not m.isascii()}
    return rules


def char_frequencies(reference: DataFrame, name: str) -> Counter[str]:
    """How often each character, and each letter with its accents, stands in the reference names; counted in the engine, bounded by Unicode."""
    chars = reference.where(F.col(name).isNotNull()).select(F.explode(F.split(name, "")).alias("c")).groupBy("c").count()
    count: Counter[str] = Counter()
    for c, n in chars.collect():
        whole = unicodedata.normalize("NFD", c)
        for part in {whole, *whole}:
            count[part] += n
    return count


class Rewriter:
    """Canonical forms by an automaton over the rules; built once in each worker."""

    _built: dict[int, Rewriter] = {}

    def __init__(self, rules: dict[str, str]) -> None:
        self.automaton = ahocorasick.Automaton()
        for a, b in rules.items():
            self.automaton.add_word(a, (len(a), b))
        for i in _assigned():
            c = chr(i)
            kind = unicodedata.category(c)
            if c in INVISIBLE or kind == "Cf":
                self.automaton.add_word(c, (1, ""))
            elif c in BLANK or (kind == "Zs" and c != " "):
                self.automaton.add_word(c, (1, " "))
        for i in range(0xE0000, 0xE01F0):  # tags and further variation selectors
            self.automaton.add_word(chr(i), (1, ""))
        self.automaton.make_automaton()

    @classmethod
    def shared(cls, key: int, rules: dict[str, str]) -> Rewriter:
        if key not in cls._built:
            cls._built.clear()
            cls._built[key] = cls(rules)
        return cls._built[key]

    def canonical(self, text: str | None) -> str | None:
        if text is None:
            return None
        if not text.isascii():
            text, seen = unicodedata.normalize("NFD", text), set()
            while text not in seen and not text.isascii():  # what was rewritten may stand together as another pattern
                seen.add(text)
                out, at = [], 0
                for end, (size, new) in self.automaton.iter_long(text):
                    out += (text[at : end + 1 - size], new)
                    at = end + 1
                text = unicodedata.normalize("NFD", "".join(out) + text[at:])
        return fold_plain(text) or None


def fold_plain(text: str) -> str:
    """Plain white space trimmed and each run of it made one space."""
    return _PLAIN.sub(" ", text).strip(" ")


def with_canonical(df: DataFrame, text: str, rules: dict[str, str], canon: str = "canon", plain: str = "plain") -> DataFrame:
    """df with the canonical form of a column and its text with plain white space folded, both null for null or blank.

    Columns already called like the new ones are replaced.
    """
    kept = [c for c in df.columns if c not in (canon, plain)]
    shared, key = df.sparkSession.sparkContext.broadcast(rules), hash(frozenset(rules.items()))
    schema = StructType([*[df.schema[c] for c in kept], *[StructField(c, StringType()) for c in (canon, plain)]])

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewriter = Rewriter.shared(key, shared.value)
        for b in batches:
            values = b.column(b.schema.get_field_index(text)).to_pylist()
            made = [pa.array([rewriter.canonical(t) for t in values], pa.string()), pa.array([t and (fold_plain(t) or None) for t in values], pa.string())]
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in kept], *made], names=[*kept, canon, plain])

    return df.mapInArrow(convert, schema)


def match_disguised(texts: DataFrame, text: str, register: DataFrame, name_id: str, name: str, rules: dict[str, str]) -> DataFrame:
    """Rows of texts that read as a registered name but are made of other characters, with its id.

    Of registered names that read alike the one with the smallest id counts. The register is brought to one row per
    form; it is broadcast while names and bytes are few (counted), else joined with hot forms spread over salts. A
    column of texts called like the id is replaced.
    """
    known = register.select(name_id, name).where(F.col(name).isNotNull())
    canon, plain, names = "__sl_canon", "__sl_plain", "__sl_names"
    size = known.agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length(name)).alias("width")).first()
    forms = with_canonical(known, name, rules, canon, plain).where(F.col(canon).isNotNull())
    forms = forms.groupBy(canon).agg(F.min(name_id).alias(name_id), F.collect_set(plain).alias(names))
    small = bounded_broadcast(forms, size["n"], 4 * (size["width"] or 0) + 64)
    read = with_canonical(texts.drop(name_id), text, rules, canon, plain).where(F.col(canon).isNotNull())
    if small is not forms:
        met = read.join(small, canon)
    else:
        spread = [c for c in texts.columns if c not in (name_id, text)] or [canon]
        met = salted_join(read, forms, [canon], spread, hot_keys(read, [canon]))
    return met.where(~F.array_contains(names, F.col(plain))).drop(canon, plain, names)
