"""Benchmark decontamination with DataFrame functions only.

Benchmark texts give windows of ``width`` consecutive normalised words (a shorter text gives one window of all its
words). Each window is found by its anchor, of its runs of ``RUN`` words the one with the least hash. Every run of the
training words is looked up inside one generated loop, and where an anchor stands the window around it is verified word
by word, so only true hits count. Windows whose words fit the broadcast bound are broadcast whole and verified there.
Of more windows only a bitmap of their anchors' hashes goes out, of a fixed size; runs that pass it travel with the words
around them and are verified in a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.session import broadcast_if_small, cut_lineage

#: Between words: controls, punctuation and spaces of ASCII. Words keep digits, letters and all other characters.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
#: The same before A-Z are lower-cased.
PLAIN_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: Words of an anchor.
RUN = 3
#: Windows that are broadcast with their words, and the bytes of those words.
BROADCAST_WINDOWS = 200_000
BROADCAST_BYTES = 64 << 20
#: 64-bit entries of the anchors' bitmap: 16 MB.
BITMAP = 1 << 21

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal_words(text: Column) -> Column:
    """Words of the text with A-Z lower-cased; null and wordless texts have none."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    ascii_only = F.octet_length(text) == F.length(text)  # then the quick lower() touches A-Z alone
    return F.array_remove(F.split(F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER)), GAP + "+", -1), "")


def benchmark_windows(benchmark: DataFrame, width: int) -> DataFrame:
    """Windows of the items: ``size`` words and their array ``window``."""
    w = F.col("words")
    items = benchmark.select("item_id", normal_words(F.col("text")).alias("words")).where(F.size("words") > 0)
    size = F.least(F.size(w), F.lit(width))
    windows = F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.slice(w, i, size))
    return items.select("item_id", size.alias("size"), F.explode(windows).alias("window"))


def bounded(windows: DataFrame) -> bool:
    got = windows.agg(F.count("*").alias("n"), F.sum(F.length(F.array_join("window", " "))).alias("bytes")).first()
    return got["n"] <= BROADCAST_WINDOWS and (got["bytes"] or 0) * 4 <= BROADCAST_BYTES


def _run_hash(words: Column, at: Column, size: Column) -> Column:
    """Hash of the run of ``least(RUN, size)`` words from the 0-based ``at``; null words are beyond the run and count nothing."""
    return F.xxhash64(*[F.when(size > k, F.get(words, at + k)) for k in range(RUN)])


def _anchored(windows: DataFrame) -> DataFrame:
    """Windows with ``anchor``, the least hash among their runs, its 0-based ``place`` and ``run``, its words."""
    run = F.least(F.lit(RUN), F.col("size"))
    each = F.transform(F.sequence(F.lit(0), F.col("size") - run), lambda i: F.struct(_run_hash(F.col("window"), i, run).alias("h"), i.alias("i")))
    return windows.select("size", "window", F.array_min(each).alias("_a"), run.alias("run")).select(
        "size", "window", F.col("_a.h").alias("anchor"), F.col("_a.i").alias("place"), "run"
    )


def _bitmap(anchored: DataFrame, entries: int) -> Column:
    """All anchors' hashes as bits of one array, a scalar subquery."""
    bits = anchored.select(F.pmod(F.shiftright("anchor", 6), F.lit(entries)).alias("at"), F.expr("shiftleft(1L, CAST(anchor & 63 AS INT))").alias("bit"))
    bits = bits.groupBy("at").agg(F.bit_or("bit").alias("bits"))
    slots = anchored.sparkSession.range(entries).select(F.col("id").alias("at")).join(bits, "at", "left")
    return slots.agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits"))))["bits"].alias("m")).scalar()


def benchmark_hits(
    docs: DataFrame, benchmark: DataFrame, width: int = 10, whole: bool | None = None, entries: int = BITMAP, ends: bool = False
) -> DataFrame:
    """One row per (``doc_id``, 1-based word position ``at``, window ``size``, ``window``) that stands in the document.

    ``whole`` says whether the windows are broadcast with their words; left out, their number and bytes decide. With
    ``ends`` every document also has the window ``[""]`` behind its last word: the same pass tells how many words it has.
    """
    windows = benchmark_windows(benchmark, width).select("size", "window").distinct()
    words = normal_words(F.col("text"))
    if ends:
        windows = windows.unionByName(docs.sparkSession.sql("SELECT 1 AS size, array('') AS window"))
        words = F.concat(words, F.array(F.lit("")))
    windows = cut_lineage(_anchored(windows))
    words = docs.select("doc_id", words.alias("words"))
    runs = [r[0] for r in windows.where("window[0] != ''").select("run").distinct().collect()] or [1]  # at most RUN
    # outer, or the optimiser puts a filter on the words' number in front, which splits every text once more
    each = words.select("doc_id", "words", F.posexplode_outer("words").alias("p", "_word")).drop("_word")
    keys = [_run_hash(F.col("words"), F.col("p"), F.lit(n)) for n in runs]
    each = each.select("doc_id", "words", "p", (keys[0] if len(keys) == 1 else F.explode(F.array(*keys))).alias("h"))
    at = F.col("p") - F.col("place") + 1  # where a window with its anchor here begins
    same = F.col("h") == F.col("anchor")  # one 64-bit key, the quickest table there is; the words decide
    if bounded(windows) if whole is None else whole:
        stands = (at > 0) & (F.slice("words", F.greatest(at, F.lit(1)), F.col("size")) == F.col("window"))
        return each.join(F.broadcast(windows), same & stands).select("doc_id", at.alias("at"), "size", "window")
    # what passes the bitmap travels, with the words that a window around it can have
    seen = F.get(_bitmap(windows, entries), F.pmod(F.shiftright("h", 6), F.lit(entries)).cast("int"))
    passed = each.where(F.expr("shiftleft(1L, CAST(h & 63 AS INT))").bitwiseAND(seen) != 0)
    lead = F.least(F.col("p"), F.lit(width - 1))
    passed = passed.select("doc_id", "h", "p", lead.alias("lead"), F.slice("words", F.col("p") - lead + 1, lead + width).alias("near"))
    stands = (at > 0) & (F.slice("near", F.greatest(F.col("lead") - F.col("place") + 1, F.lit(1)), F.col("size")) == F.col("window"))
    return passed.join(windows, same & stands).select("doc_id", at.alias("at"), "size", "window")


def covered_spans(hits: DataFrame) -> DataFrame:
    """``doc_id`` and ``spans``: the hits of each document merged to disjoint word ranges (``at`` 1-based, ``end`` exclusive)."""
    ends = hits.select("doc_id", "at", (F.col("at") + F.col("size")).alias("end")).groupBy("doc_id", "at").agg(F.max("end").alias("end"))
    spans = ends.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "end"))).alias("s"))
    last = lambda a: F.try_element_at(a, F.lit(-1))

    def add(a: Column, x: Column) -> Column:
        joined = F.struct(last(a)["at"].alias("at"), F.greatest(last(a)["end"], x["end"]).alias("end"))
        return F.when((F.size(a) > 0) & (x["at"] <= last(a)["end"]), F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(joined))).otherwise(F.concat(a, F.array(x)))

    return spans.select("doc_id", F.aggregate("s", F.slice("s", 1, 0), add).alias("spans"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256`` and ``contaminated`` of every row of ``docs``.

    ``n_hit`` counts words inside an occurring window, ``n_items`` the items with one. Null or wordless texts have no
    words and no hits; an empty benchmark hits nothing. A very long text is one row of one task, which holds its words. Rows are told apart by (``doc_id``, text), so repeated rows and
    rows of one id with other texts each get their own counts; a null ``doc_id`` is a value like any other. Items with
    a null ``item_id`` hit words but are not listed.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("_row", F.md5(F.concat_ws("\0", F.col("doc_id").cast("string"), F.col("text")).cast("binary")))
    found = cut_lineage(benchmark_hits(docs.select(F.col("_row").alias("doc_id"), "text"), benchmark, width, ends=True).distinct())
    hits = found.where("window[0] != ''")
    items = benchmark_windows(benchmark, width).where("item_id IS NOT NULL").select("size", "window", "item_id").distinct()
    items = F.broadcast(items) if bounded(items) else items  # a window may be very common among the hits
    named = hits.join(items, ["size", "window"]).select("doc_id", F.col("item_id").cast("string").alias("item")).distinct()
    listed = named.groupBy("doc_id").agg(F.array_sort(F.collect_list("item")).alias("items")).select(
        F.col("doc_id").alias("_item_row"), F.size("items").cast("bigint").alias("n_items"), F.array_join("items", ",").alias("items")
    )
    spans = covered_spans(hits)
    covered = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, x: n + x["end"] - x["at"])
    spans = spans.select(F.col("doc_id").alias("_hit_row"), covered.alias("n_hit"))
    counts = found.where("window[0] = ''").select(F.col("doc_id").alias("_counted"), (F.col("at") - 1).cast("bigint").alias("n_words"))
    counts = docs.select("doc_id", "_row").join(counts, F.col("_row") == F.col("_counted"))
    out = counts.join(spans, F.col("_row") == F.col("_hit_row"), "left").join(listed, F.col("_row") == F.col("_item_row"), "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("bigint")).alias("n_items"), F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0).cast("bigint")) > 0).alias("contaminated"),
    )


def remove_contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, remove: str = "documents") -> DataFrame:
    """``docs`` without its benchmark windows, with all columns: whole rows go, or with ``remove="spans"`` only the words hit.

    A removed word takes the characters before it (spaces, punctuation) along, back to the word before; what stands
    behind the last word stays. Texts without a hit stay as they are, null, empty and wordless ones too. Rows of equal
    text are treated alike, so ties and null ids need no rule. A very long text is one row of one task.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is documents or spans")
    names = [f"_c{i}" for i in range(len(docs.columns))]
    text = F.col(names[docs.columns.index("text")]).cast("string")
    rows = docs.toDF(*names).withColumn("_text_md5", F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    hits = benchmark_hits(rows.select(F.col("_text_md5").alias("doc_id"), text.alias("text")), benchmark, width)
    back = [F.col(n).alias(c) for n, c in zip(names, docs.columns)]
    if remove == "documents":
        found = cut_lineage(hits.select(F.col("doc_id").alias("_text_md5")).distinct())
        return rows.join(broadcast_if_small(found), "_text_md5", "left_anti").select(*back)
    spans = cut_lineage(covered_spans(hits.distinct()).withColumnRenamed("doc_id", "_text_md5"))
    pieces = F.regexp_extract_all(text, F.lit(f"{PLAIN_GAP}*[^{PLAIN_GAP[1:]}+"), F.lit(0))  # each word with what stands before it
    kept = F.filter(pieces, lambda x, i: ~F.exists("spans", lambda s: (i + 1 >= s["at"]) & (i + 1 < s["end"])))
    rest = F.concat(F.array_join(kept, ""), F.regexp_extract(text, f"{PLAIN_GAP}*$", 0))
    rows = rows.join(broadcast_if_small(spans), "_text_md5", "left")
    rows = rows.withColumn("_cut", F.when(F.col("spans").isNotNull(), rest).otherwise(text))
    return rows.select(*[F.col("_cut").alias(c) if c == "text" else b for c, b in zip(docs.columns, back)])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """The rows of ``docs`` without a benchmark window, with all their columns; null and wordless texts stay."""
    return remove_contamination(docs, benchmark, width)
