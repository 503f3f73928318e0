"""Evaluation items inside corpus documents, by template windows.

Words of both sides are canonicalised alike: numbers, names and units become
typed placeholders, all else stays. Which words are names is learnt from the
items: a word is a slot filler if most of its occurrences stand between two
neighbours that, numbers aside, enclose at least ``MIN_FILLERS`` different
words. Windows of 12 canonical words are hashed (the template) and so are the
words behind their placeholders (the slots). Document windows meet item
windows in a hash join on the template; then the slots are checked:

* equal slots: the window is leaked word for word (``leaked``);
* other slots: the windows of a document that lie on one line with windows of
  an item form an *occurrence*, and over all of it each value of the item must
  stand for one value of the document and the other way round; then the
  question was re-parameterised (``variants``).

Items do not meet documents one by one. Windows that occur in the same items
form a *window class*, named by a hash of that set of items, and a document
meets each class once; items with the same whole template and the same pattern
of equal slots form an *item class*, of which any member is consistent with a
text if one is, so only the least member meets the documents. Both come with
their members, and pairs are expanded once, at the end, so no link is lost.

Every word of every document is hashed. Where the item windows' hashes are at
most ``BROADCAST_BYTES`` they are sent to the executors, and a document window
leaves its task only if its template occurs in an item; above that size all
document windows go through the shuffle join. Up to ``MOST_NAMES`` names are
sent as well; beyond it they are joined to the words. All ways give the same
rows.

Defined results: null and empty texts, and items shorter than a window, match
nothing; repeated rows and ties do not repeat results; empty tables give empty
results. A window with fewer than ``MIN_FIXED`` words besides its placeholders
can be leaked but is no evidence of a variant.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanforge.llm.words import Codes, mixed, window_hashes, words
from spanforge.session import stored

WINDOW = 12
MIN_FILLERS = 4
MIN_FIXED = 4
BROADCAST_BYTES = 64 << 20
MOST_NAMES = 200_000
#: Units of measure that are placeholders of their own, in the languages of the items.
UNITS = (
    "s ms us ns seconds second milliseconds millisecond microseconds microsecond nanoseconds minutes minute hours hour days day weeks week "
    "bytes byte bits bit kb mb gb tb kib mib gib percent ticks tick points marks times sekunden sekunde millisekunden mikrosekunden minuten stunden tage tag takte prozent punkte"
).split()
NUMBER, NAME, UNIT = (mixed(np.array([k], np.uint64))[0] for k in (11, 12, 13))


class Canon(dict):
    """Word to canonical code; ``slots`` has 0 for words that stay and the word's hash for those behind a placeholder."""

    def __init__(self, names: frozenset[str], most: int = 300_000) -> None:
        super().__init__()
        self.names, self.units, self.words, self.most = names, frozenset(UNITS), Codes(most), most

    def kind(self, w: str) -> int | None:
        return int(NUMBER) if w[0].isdigit() else int(NAME) if w in self.names else int(UNIT) if w in self.units else None

    def __missing__(self, w: str) -> int:
        if len(self) >= self.most:
            self.clear()
        k = self.kind(w)
        self[w] = v = self.words[w] if k is None else k
        return v

    def codes(self, ws: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), np.uint64, len(ws))

    def slots(self, ws: list[str]) -> np.ndarray:
        return np.fromiter((0 if self.kind(w) is None else self.words[w] for w in ws), np.uint64, len(ws))


def words_of(text: str | None) -> list[str]:
    return words(text) if text else []


_taken = F.udf(words_of, T.ArrayType(T.StringType()), useArrow=True)


def slot_names(items: DataFrame, text: str) -> DataFrame:
    """(word) names among the items' words, by the variety of words between the same neighbours."""
    w = items.where(F.col(text).isNotNull()).select(_taken(text).alias("w")).where("size(w) > 0")
    shape = F.transform("w", lambda x: F.when(x.rlike(r"^\p{Nd}"), "0").otherwise(x))
    w = w.select("w", shape.alias("s")).select("s", F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - 1), lambda k: F.struct(F.get("w", k).alias("word"), F.get("s", k - 1).alias("l"), F.get("s", k + 1).alias("r")))).alias("x")).select("x.*")
    per = stored(w.where(F.col("word").rlike(r"^[^\p{Nd}]")).groupBy("l", "r", "word").agg(F.count(F.lit(1)).alias("n")), "words")
    slots = per.groupBy("l", "r").agg(F.count(F.lit(1)).alias("fillers"))
    on = per["l"].eqNullSafe(slots["l"]) & per["r"].eqNullSafe(slots["r"])
    share = F.sum(F.when(F.col("fillers") >= MIN_FILLERS, F.col("n")).otherwise(0)) / F.sum("n")
    return stored(per.join(slots, on).groupBy("word").agg(share.alias("share")).where("share > 0.5").select("word"), "names")


def name_places(rows: DataFrame, names: DataFrame) -> DataFrame:
    """(id, text, places) with the places of names among the words, for more names than are sent."""
    at = rows.select("id", F.monotonically_increasing_id().alias("row"), "text")
    at = stored(at, "numbered")
    words_ = at.select("row", F.posexplode(_taken("text")).alias("place", "word"))
    hits = words_.join(names, "word").groupBy("row").agg(F.collect_list("place").alias("places"))  # at most a text's own words
    return at.join(hits, "row", "left").select("id", "text", F.coalesce("places", F.array().cast("array<int>")).alias("places"))


WINDOWS = "id long, at int, template long, slots long, values array<long>"


def _windows(names: frozenset[str], wanted: np.ndarray | None, values: bool):
    """Arrow batches of (id, text[, places of names]) to windows, all or those with a wanted template; ``values`` gives the slots one by one."""
    mask = np.uint64((1 << 22) - 1)
    table = None
    if wanted is not None:
        table = np.zeros(1 << 22, bool)
        table[(wanted & mask).astype(np.int64)] = True
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = Canon(names)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                out: tuple[list, ...] = ([], [], [], [], [])
                places = part.column(2).to_pylist() if part.num_columns > 2 else [None] * part.num_rows
                for i, t, where in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), places):
                    if not t or len(ws := words(t)) < WINDOW:
                        continue
                    codes = canon.codes(ws)
                    if where:
                        codes[where] = NAME
                    h = window_hashes(codes, WINDOW)
                    at = np.arange(len(h))
                    if table is not None:
                        at = np.flatnonzero(table[(h & mask).astype(np.int64)])
                        if len(at):
                            at = at[np.isin(h[at], wanted)]
                        if not len(at):
                            continue
                    slots = canon.slots(ws)
                    for k in where or ():
                        slots[k] = canon.words[ws[k]]
                    s = window_hashes(slots, WINDOW)
                    each = slots[at[:, None] + np.arange(WINDOW)].view(np.int64).tolist() if values else [None] * len(at)
                    for o, v in zip(out, (np.full(len(at), i, np.int64), at.astype(np.int32), h[at].view(np.int64), s[at].view(np.int64), each)):
                        o.append(v)
                cols = [np.concatenate(o) if o else np.empty(0, np.int64) for o in out[:4]]
                last = [v for o in out[4] for v in o]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((*cols, last), kinds)], names=["id", "at", "template", "slots", "values"])

    return run


def windows(docs: DataFrame, ident: str, text: str, names: DataFrame, wanted: np.ndarray | None = None, values: bool = False, most_names: int = MOST_NAMES) -> DataFrame:
    """(id, at, template, slots, values) of the windows of each text."""
    rows = docs.select(F.col(ident).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
    if names.limit(most_names + 1).count() <= most_names:
        sent = frozenset(r["word"] for r in names.collect())  # at most most_names words
    else:
        sent, rows = frozenset(), name_places(rows, names)
    return rows.mapInArrow(_windows(sent, wanted, values), WINDOWS)


class Matcher:
    """Document windows against item windows, in the ways the results need."""

    def __init__(self, docs: DataFrame, doc_id: str, doc_text: str, items: DataFrame, item_id: str, item_text: str, broadcast_bytes: int = BROADCAST_BYTES, most_names: int = MOST_NAMES) -> None:
        self.docs, self.doc_id, self.doc_text, self.bytes, self.most_names = docs, doc_id, doc_text, broadcast_bytes, most_names
        self.names = slot_names(items, item_text)
        self.items = stored(windows(items, item_id, item_text, self.names, values=True, most_names=most_names).distinct(), "items")

    def met(self, wanted: DataFrame, values: bool) -> DataFrame:
        """Document windows whose template is one of ``wanted`` (template)."""
        sent = None
        if wanted.count() * 8 <= self.bytes:
            sent = np.unique(np.array([r[0] for r in wanted.collect()], np.int64).view(np.uint64))  # at most self.bytes
        dw = windows(self.docs, self.doc_id, self.doc_text, self.names, sent, values, self.most_names)
        return dw if sent is not None else dw.join(wanted, "template", "left_semi").select("id", "at", "template", "slots", "values")

    def window_classes(self) -> DataFrame:
        """(template, slots, class_id): windows that occur in the same items have one class."""
        one = self.items.select("template", "slots", "id").distinct()
        name = F.xxhash64(F.bit_xor(F.xxhash64("id")), F.bit_xor(F.xxhash64(F.col("id"), F.lit("again"))), F.count(F.lit(1)))
        return one.groupBy("template", "slots").agg(name.alias("class_id"))

    def leaked_classes(self) -> DataFrame:
        """(doc_id, class_id, n_windows): window classes of which a document has windows word for word."""
        dw = self.met(self.items.select("template").distinct(), False)
        return (
            dw.groupBy("id", "template", "slots").agg(F.lit(1).alias("n")).join(self.window_classes(), ["template", "slots"])
            .groupBy(F.col("id").alias("doc_id"), "class_id").agg(F.count(F.lit(1)).alias("n_windows"))
        )

    def window_members(self) -> DataFrame:
        """(class_id, item_id) of the window classes."""
        return self.window_classes().join(self.items.select("template", "slots", F.col("id").alias("item_id")).distinct(), ["template", "slots"]).select("class_id", "item_id").distinct()

    def leaked(self) -> DataFrame:
        """(doc_id, item_id, n_windows): items of which a document has a whole window with equal slots."""
        return self.leaked_classes().join(self.window_members(), "class_id").groupBy("doc_id", "item_id").agg(F.sum("n_windows").alias("n_windows"))

    def item_classes(self) -> DataFrame:
        """(item_id, class_id): items of one whole template and one pattern of equal slots, named by the least."""
        v = self.items.select("id", F.posexplode("values").alias("k", "value"), "at").select("id", (F.col("at") + F.col("k")).alias("place"), "value").where("value <> 0").distinct()
        first = v.groupBy("id", "value").agg(F.min("place").alias("first"))
        pattern = v.join(first, ["id", "value"]).groupBy("id").agg(F.bit_xor(F.xxhash64("place", "first")).alias("pattern"))
        template = self.items.groupBy("id").agg(F.bit_xor(F.xxhash64("at", "template")).alias("text"), F.count(F.lit(1)).alias("n"))
        whole = template.join(pattern, "id", "left")
        least = whole.groupBy("text", "n", "pattern").agg(F.min("id").alias("class_id"))
        on = (whole["text"] == least["text"]) & (whole["n"] == least["n"]) & whole["pattern"].eqNullSafe(least["pattern"])
        return whole.join(least, on).select(whole["id"].alias("item_id"), "class_id")

    def evidence(self) -> DataFrame:
        """Item windows with placeholders and with words enough besides."""
        fixed = F.size(F.filter("values", lambda v: v == 0))
        return self.items.where((fixed >= MIN_FIXED) & (fixed < WINDOW))

    def met_evidence(self) -> DataFrame:
        return stored(self.met(self.evidence().select("template").distinct(), True).distinct(), "met")

    def occurrences(self, met: DataFrame, classes: DataFrame) -> DataFrame:
        """(doc_id, class_id, line, n_windows): consistent occurrences of item classes.

        On a line lie the windows whose places in document and item differ by
        the same number. Over all their slots the pairs (value of the item,
        value of the document) must be a one to one relation.
        """
        iw = self.evidence().join(classes.select(F.col("class_id").alias("id")).distinct(), "id", "left_semi")
        iw = iw.select(F.col("id").alias("class_id"), F.col("at").alias("item_at"), "template", F.col("values").alias("item_value"))
        both = met.withColumnRenamed("values", "doc_value").join(iw, "template")
        line = stored(both.select(F.col("id").alias("doc_id"), "class_id", (F.col("at") - F.col("item_at")).alias("line"), F.arrays_zip("item_value", "doc_value").alias("v")), "lines")
        by = ["doc_id", "class_id", "line"]
        pairs = line.select(*by, F.explode("v").alias("p")).select(*by, "p.*").where("item_value <> 0").distinct()
        good = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("item_value").alias("ni"), F.count_distinct("doc_value").alias("nd")).where("n = ni and n = nd")
        return line.groupBy(*by).agg(F.count(F.lit(1)).alias("n_windows")).join(good.select(*by), by, "left_semi")

    def variant_classes(self, met: DataFrame | None = None, classes: DataFrame | None = None) -> DataFrame:
        """(doc_id, class_id, n_windows): item classes with consistent occurrences in a document, the longest counted."""
        found = self.occurrences(met or self.met_evidence(), classes or stored(self.item_classes(), "classes"))
        return found.groupBy("doc_id", "class_id").agg(F.max("n_windows").alias("n_windows"))

    def variants(self) -> DataFrame:
        """(doc_id, item_id, n_windows): items that occur re-parameterised, all members of a class; those that occur word for word in as many windows are leaks, not variants."""
        met, classes = self.met_evidence(), stored(self.item_classes(), "classes")
        every = self.variant_classes(met, classes).join(classes, "class_id")
        same = self.evidence().select("template", "slots", F.col("id").alias("item_id")).distinct()
        copied = met.select("id", "template", "slots").distinct().join(same, ["template", "slots"]).groupBy(F.col("id").alias("doc_id"), "item_id").agg(F.count(F.lit(1)).alias("n_copied"))
        left = every.join(copied, ["doc_id", "item_id"], "left")
        return left.where(F.coalesce("n_copied", F.lit(0)) < F.col("n_windows")).select("doc_id", "item_id", "n_windows")
