"""Line-first document cleaning.

Every line is judged by three rules -- punctuation, navigation, boilerplate --
failing lines are removed, and a document that loses too many of its words that
way is rejected, as is one that fails the base signals.

Punctuation: a line has to end its sentences; a short one may be a heading, and the
last sentence of a long one may be cut off. Words must not be noise. Navigation: a line
may not consist of separators to a good part. Boilerplate: fixed phrases in the
corpus's languages, and what the corpus itself shows to be boilerplate: lines that at
least ``common_least`` different texts hold, texts that are otherwise unlike each other. Each of a
line's texts is known by one other line of it (the one with the smallest MD5), and these
have to differ in ``company_percent`` of the texts: a line of near copies keeps the same company, a
footer does not. Copies of a text count once, so does a refrain inside one. Both numbers say
nothing of the table's size, so a small site's footer is found in a corpus of any size. The
lines found grow with the corpus: up to ``most_broadcast`` their hashes go to the executors, beyond
it they meet the documents' lines in a join, with the same results.

Defined results: a null or empty text has no words, all counts 0, fails the base
test and is not kept; very long texts and lines are judged whole; repeated rows are
judged one by one; other columns of the input, whatever their names, are not looked
at; an empty table gives an empty one. Two passes over the input; only hashes of
lines are shuffled (and the texts, where the lines found are joined).
"""

from __future__ import annotations

import re
from collections.abc import Collection
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandspark.llm.texts import ROWS, WORD, free_name, map_texts, plain_names, quoted, renamed, words
from strandspark.runtime import written

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_lines_removed long, n_words_removed long, cleaned string"
)


@dataclass(frozen=True)
class LineRules:
    """Thresholds of the line rules; percentages of a line's words."""

    min_words: int = 50
    max_repeat_percent: int = 50
    #: A document that loses more than this percentage of its words goes.
    max_loss_percent: int = 30
    #: Words with symbols or repeated exclamation marks, from which a line fails.
    max_noisy_percent: int = 30
    #: A line without a sentence mark may have fewer words than this ...
    open_line: int = 10
    #: ... and the words after the last mark of a line fewer than this.
    long_line: int = 40
    #: Separators of menus and breadcrumbs, and their share of a line's words.
    separators: tuple[str, ...] = ("|", "»", ">", "•", "::", "/", "·", "›", "→")
    max_separator_percent: int = 20
    #: A line of at least this many different texts is boilerplate ...
    common_least: int = 20
    #: ... if this percentage of them differ in their company.
    company_percent: int = 70
    #: So many hashes of such lines are broadcast (8 bytes each; about 70 in a Python worker); more are joined.
    most_broadcast: int = 200_000
    boilerplate: str = (
        r"all rights reserved|licensed under|released under the|terms of (?:use|service)|privacy policy|"
        r"cookie policy|we use cookies|accept cookies|copyright (?:©|\(c\))|powered by|click here|"
        r"sign up for|subscribe to our|log in to|enable javascript|"
        r"alle rechte vorbehalten|nutzungsbedingungen|cookies akzeptieren|"
        r"tous droits r|conditions d'utilisation|accepter les cookies|"
        r"todos los derechos reservados|aviso legal|aceptar las cookies"
    )


#: What ends a sentence.
MARKS = ".!?…。！？؟।"
NOISY = re.compile(rb"[#*$%&<>]|!!|\?\?")
SYMBOLS = re.compile(r"[#*$%&|<>]")


def repeated_words(w: list[bytes]) -> int:
    """Words in 3-word windows that the text has twice or more."""
    n = len(w) - 2
    if n < 2:
        return 0
    grams = list(zip(w, w[1:], w[2:]))
    if len(set(grams)) == n:
        return 0
    first: dict[tuple, int] = {}
    hit = bytearray(n + 2)
    for i, g in enumerate(grams):
        j = first.setdefault(g, i)
        if j != i:
            hit[i] = hit[i + 1] = hit[i + 2] = 1
            hit[j] = hit[j + 1] = hit[j + 2] = 1
    return sum(hit)


class Judge:
    """The rules, ready for use on the executors."""

    def __init__(self, rules: LineRules, common: frozenset[int] = frozenset()):
        self.rules, self.common = rules, common
        self.boilerplate = re.compile(rules.boilerplate.encode(), re.I)
        self.separators = frozenset(s.encode() for s in rules.separators)
        self.may_separate = re.compile(b"|".join(re.escape(s) for s in sorted(self.separators)))
        self.marks = [m.encode() for m in MARKS]

    def open_words(self, line: bytes, n: int) -> int:
        """Words after the last sentence mark of a line of ``n`` words."""
        if line[-1:] in (b".", b"!", b"?"):
            return 0
        end = max((at + len(m) for m in self.marks if (at := line.rfind(m)) >= 0), default=0)
        return len(line[end:].split()) if end else n

    def fails(self, line: bytes, w: list[bytes], common: Collection[int] = ()) -> bool:
        """``common``: hashes of common lines of the text at hand, beside those that hold for all."""
        n, rules = len(w), self.rules
        if self.common or common:
            h = signed(xxhash.xxh64_intdigest(line, LINE_SEED))
            if h in self.common or h in common:
                return True
        if self.may_separate.search(line) and 100 * sum(x in self.separators for x in w) > rules.max_separator_percent * n:
            return True
        if NOISY.search(line) and 100 * sum(NOISY.search(x) is not None for x in w) > rules.max_noisy_percent * n:
            return True
        if n >= rules.open_line and (left := self.open_words(line, n)) and (left == n or left >= rules.long_line):
            return True
        return self.boilerplate.search(line) is not None


#: The seed of Spark's XXH64.
LINE_SEED = 42


def signed(h: int) -> int:
    """An unsigned 64-bit number as Spark's long."""
    return h - (1 << 64) if h >> 63 else h


def text_keys(text: Column) -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def text_lines(docs: DataFrame, text_col: str) -> DataFrame:
    """(k1, k2, lines): each text's lines that have a word, once each."""
    text = F.col(text_col)
    return docs.where(text.isNotNull()).select(*text_keys(text), F.array_distinct(F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))).alias("lines"))


def common_lines(docs: DataFrame, text_col: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """(line): hashes of the lines that the corpus shows to be boilerplate (see the module)."""
    named = F.array_sort(F.transform("lines", lambda x: F.struct(F.md5(x).alias("h"), F.xxhash64(x).alias("line"))))
    own = text_lines(docs, text_col).select("k1", "k2", named.alias("x"))
    # A line's company is the text's first other line in the order of the MD5.
    first, second = (F.coalesce(F.xxhash64(F.try_element_at("x", F.lit(i)).h), F.lit(0)) for i in (1, 2))
    lone = F.when(F.size("x") > 1, second).otherwise(F.lit(0).cast("long"))
    own = own.select("k1", "k2", F.posexplode("x").alias("pos", "x"), lone.alias("second"), first.alias("first"))
    own = own.select("k1", "k2", "x.line", F.when(F.col("pos") == 0, F.col("second")).otherwise(F.col("first")).alias("company"))
    met = own.distinct().groupBy("line", "company").agg(F.count(F.lit(1)).alias("n"))
    found = met.groupBy("line").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("companies"))
    return found.where((F.col("n") >= rules.common_least) & (100 * F.col("companies") >= rules.company_percent * F.col("n"))).select("line")


def with_common(docs: DataFrame, text_col: str, name: str, rules: LineRules) -> tuple[DataFrame, frozenset[int]]:
    """``docs`` with a column ``name`` of the hashes of each text's common lines, empty where the
    second result has those of all texts."""
    found = written(common_lines(docs, text_col, rules), "common-lines")
    if found.count() <= rules.most_broadcast:
        return docs.withColumn(name, F.array().cast("array<long>")), frozenset(r["line"] for r in found.collect())
    lines = text_lines(docs, text_col).select("k1", "k2", F.explode(F.transform("lines", lambda x: F.xxhash64(x))).alias("line"))
    per = lines.distinct().join(found, "line", "left_semi").groupBy("k1", "k2").agg(F.collect_set("line").alias("own_common"))
    a, b, own = (free_name([*docs.columns, name], x) for x in ("k1", "k2", "own_common"))
    k1, k2 = text_keys(F.col(text_col))
    per = per.toDF(a + "_", b + "_", own)
    keyed = docs.withColumn(a, k1).withColumn(b, k2)
    keyed = keyed.join(per, (F.col(a) == F.col(a + "_")) & (F.col(b) == F.col(b + "_")), "left")
    return keyed.select(*quoted(docs.columns), F.coalesce(F.col(own), F.array().cast("array<long>")).alias(name)), frozenset()


def judge(text: str | None, by: Judge, common: Collection[int] = ()) -> tuple:
    text, rules = text or "", by.rules
    w = words(text)
    n = len(w)
    chars = len(text) - sum(text.count(c) for c in " \t\n\v\f\r")
    symbols = len(SYMBOLS.findall(text))
    lines = text.split("\n")
    kept, seen, dup, lost, lost_lines = [], set(), 0, 0, 0
    for line in lines:
        raw = line.encode()
        lw = raw.split()
        if lw:
            if line in seen:
                dup += 1
            else:
                seen.add(line)
            if by.fails(raw, lw, common):
                lost += len(lw)
                lost_lines += 1
                continue
        kept.append(line)
    again = repeated_words(w)
    failed = n < rules.min_words or 100 * again > rules.max_repeat_percent * n
    ok = not failed and 100 * lost <= rules.max_loss_percent * n
    return n, chars, symbols, dup, again, failed, ok, lost_lines, lost, "\n".join(kept) if lost_lines else text


def clean_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """Signals, verdict and cleaned text of each document (see the module)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    docs, common = with_common(docs, "text", "common", rules)
    by = docs.sparkSession.sparkContext.broadcast(Judge(rules, common))
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    types = {"string": pa.string(), "boolean": pa.bool_(), "long": pa.int64()}
    kinds = [types[x.split()[1]] for x in SCHEMA.split(", ")]

    def run(c: dict[str, list]) -> pa.RecordBatch:
        rows = [judge(t, by.value, own) for t, own in zip(c["text"], c["common"])]
        cols = [c["doc_id"], *(list(x) for x in zip(*rows))] if rows else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols, kinds)], names=names)

    return map_texts(docs, run, SCHEMA)


def keep_clean(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars", rules: LineRules = LineRules()) -> DataFrame:
    """The kept documents with all their columns, without the lines that fail;
    ``chars_col``, where there is one, is the new text's number of characters."""
    names, docs = docs.columns, plain_names(docs)
    schema, extra = docs.schema, free_name(docs.columns, "common")
    docs, common = with_common(docs, text_col, extra, rules)
    by = docs.sparkSession.sparkContext.broadcast(Judge(rules, common))

    def run(it):
        for whole in it:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                own = b.column(extra).to_pylist()
                b = b.drop_columns([extra])
                k = b.schema.get_field_index(text_col)
                rows = [judge(t, by.value, c) for t, c in zip(b.column(k).to_pylist(), own)]
                b = b.set_column(k, b.schema.field(k), pa.array([r[9] for r in rows], pa.string()))
                if (c := b.schema.get_field_index(chars_col)) >= 0:
                    old = b.column(c).to_pylist()
                    b = b.set_column(c, b.schema.field(c), pa.array([len(r[9]) if r[7] else n for r, n in zip(rows, old)], b.schema.field(c).type))
                yield b.filter(pa.array([r[6] for r in rows], pa.bool_()))

    return renamed(docs.mapInArrow(run, schema), names)
