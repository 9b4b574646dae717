"""Benchmark decontamination over a distributed positional inverted index.

``build_index`` stores one posting (term, document, position) per word of the training
texts, in files that each hold whole documents, so no term is one task's work.  Searches
start from the rarest terms of the tested phrases: their postings, each moved back by the
term's place in the phrase, are intersected, and only places that all of them name are
checked word by word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_checked, join_same, keyed, lower_ascii, pin

# Words are runs of letters, digits and all characters beyond ASCII.
WORDS = "[^\\\\x00-\\\\x2F\\\\x3A-\\\\x60\\\\x7B-\\\\x7F]+"
DOC = ["_id", "_th"]
#: The posting that carries a document's length; no word is empty.
LENGTH = ""


def words(text: str) -> str:
    """SQL for the array of words of a text, A-Z lower-cased."""
    return f"regexp_extract_all({lower_ascii(text)}, '{WORDS}', 0)"


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                terms: DataFrame | None = None) -> DataFrame:
    """The postings (term, _id, _th, pos) of all words, written; ``terms`` (column term) keeps
    only those of a vocabulary.  Each document also has a posting of the empty term with its
    number of words, so texts without words are in the index as well."""
    tokens = keyed(docs, id_col, text_col).selectExpr(*DOC, f"{words('_text')} AS _words")
    listed = tokens.select(*DOC, F.posexplode(F.concat("_words", F.array(F.lit(LENGTH)))).alias("pos", "term"))
    if terms is not None:
        vocabulary = pin(terms.select("term").union(terms.sparkSession.sql(f"SELECT '{LENGTH}' AS term")).distinct())
        listed = join_checked(listed, vocabulary, ["term"], "left_semi")
    return pin(listed.select("term", *DOC, "pos"))


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Different items with their words; ``_item`` numbers equal word lists alike."""
    text = words(f"coalesce(`{text_col}`, '')")
    items = benchmark.selectExpr(f"CAST(`{id_col}` AS STRING) AS item_id", f"{text} AS item_words")
    return items.where("size(item_words) > 0").withColumn("_item", F.array_join("item_words", " "))


def _rarest(items: DataFrame, postings: DataFrame, width: int, depth: int) -> DataFrame:
    """Per different item the places of the ``depth`` rarest terms of each of its windows."""
    held = pin(postings.where(F.col("term") != LENGTH).groupBy("term").agg(F.count(F.lit(1)).alias("held")))
    last = f"greatest(size(item_words) - {width}, 0)"
    places = items.select("_item", "item_words").distinct().select(
        "_item", "item_words", F.posexplode("item_words").alias("q", "term"))
    places = places.join(held, "term", "left").select(
        "_item", "item_words", "q", "term", F.coalesce("held", F.lit(0)).alias("held"))
    # A window's anchors: its rarest places; one with a term that no document has can't occur.
    own = places.groupBy("_item", "item_words").agg(
        F.array_sort(F.collect_list(F.struct("q", "term", "held"))).alias("at"))
    windows = own.select("_item", F.explode(F.expr(
        f"transform(sequence(0, {last}), s -> array_sort(transform(slice(at, s + 1, {width}), "
        "x -> struct(x.held AS held, x.q AS q, x.term AS term))))")).alias("window"))
    return windows.where("window[0].held > 0").selectExpr("_item", f"slice(window, 1, {depth}) AS anchors").distinct()


def phrase_hits(docs: DataFrame, postings: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
                text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
                width: int = 10, depth: int = 2) -> DataFrame:
    """Exact matches: one row per (document, item, shift) where a window of the item occurs,
    with ``starts``, the places in the document where windows begin, and ``length``, the words in one."""
    items = pin(_items(benchmark, item_id, item_text))
    anchors = pin(_rarest(items, postings, width, depth))
    places = pin(anchors.select("_item", F.explode("anchors").alias("x")).select("_item", "x.q", "x.term").distinct())
    # Offset-adjusted lists: where the item would begin if this posting were its q-th word.
    lists = join_checked(postings, places, ["term"], "inner").selectExpr(*DOC, "_item", "pos - q AS shift", "q")
    met = lists.groupBy(*DOC, "_item", "shift").agg(F.collect_set("q").alias("met"))
    of_item = pin(anchors.groupBy("_item").agg(F.collect_set(F.expr("transform(anchors, x -> x.q)")).alias("needed")))
    placed = join_checked(met, of_item, ["_item"], "inner").where(
        "exists(needed, w -> size(array_except(w, met)) = 0)").select(*DOC, "_item", "shift")
    per_doc = pin(placed.groupBy(*DOC).agg(F.collect_list(F.struct("_item", "shift")).alias("placed")))

    # Word by word, in the documents where the lists meet.
    texts = keyed(docs, id_col, text_col)
    found = join_checked(texts, per_doc, DOC, "inner", 100_000, "size(placed)").selectExpr(*DOC, f"{words('_text')} AS _words", "placed").dropDuplicates(DOC)
    tried = found.select(*DOC, "_words", F.explode("placed").alias("p")).selectExpr(
        *DOC, "p._item AS _item", "p.shift AS shift", "split(p._item, ' ') AS item_words", "_words")
    n = f"least(size(item_words), {width})"
    starts = tried.selectExpr(
        *DOC, "_item", "shift", f"{n} AS length",
        f"transform(filter(sequence(0, size(item_words) - {n}), s -> shift + s >= 0 AND "
        f"slice(_words, shift + s + 1, {n}) = slice(item_words, s + 1, {n})), s -> shift + s) AS starts")
    return starts.where("size(starts) > 0")


def proximity_hits(postings: DataFrame, phrases: DataFrame, within: int = 20) -> DataFrame:
    """Documents that hold all terms of a phrase at most ``within`` words apart from each other.

    ``phrases`` has columns phrase and words, A-Z lower-cased; a repeated word is one term, and a term
    without postings matches nothing.  Rows: phrase, _id, _th, pos, other, all pairs of places of the two
    rarest terms around which the other terms stand as well.  The pairs are found by joining the two
    lists on blocks of ``within`` positions.  A phrase of one term has its places as both."""
    step = max(within, 1)
    held = postings.where(F.col("term") != LENGTH).groupBy("term").agg(F.count(F.lit(1)).alias("held"))
    terms = phrases.select("phrase", F.explode("words").alias("term")).distinct().join(held, "term", "left")
    ranked = pin(terms.groupBy("phrase").agg(F.array_sort(F.collect_list(F.struct(
        F.coalesce("held", F.lit(0)).alias("held"), "term"))).alias("x")).where("x[0].held > 0"))
    place = ["phrase", *DOC, "pos", "other"]
    one = postings.join(ranked.where("size(x) = 1").selectExpr("phrase", "x[0].term AS term"), "term").selectExpr(
        "phrase", *DOC, "pos", "pos AS other")
    two = ranked.where("size(x) > 1")
    block = f"CAST(floor(pos / {step}) AS INT)"
    rare = postings.join(two.selectExpr("phrase", "size(x) AS n", "x[0].term AS term"), "term").selectExpr(
        "phrase", "n", *DOC, "pos", f"explode(sequence({block} - 1, {block} + 1)) AS block")
    next_rare = postings.join(two.selectExpr("phrase", "x[1].term AS term"), "term").selectExpr(
        "phrase", *DOC, "pos AS other", f"{block} AS block")
    pairs = pin(join_same(rare, next_rare, ["phrase", *DOC, "block"], "inner").where(
        f"abs(pos - other) <= {within}").select(*place, "n").distinct())
    # The other terms, in the reach of a window around both places: one word stands at a place.
    low, high = f"greatest(pos, other) - {within}", f"least(pos, other) + {within}"
    others = two.selectExpr("phrase", "explode(slice(x, 3, size(x))) AS y").selectExpr("phrase", "y.term AS term")
    listed = postings.join(others, "term").selectExpr("phrase", *DOC, "term", "pos AS at", f"{block} AS block")
    reach = pairs.where("n > 2").selectExpr(
        *place, "n", f"{low} AS low", f"{high} AS high",
        f"explode(sequence(CAST(floor(({low}) / {step}) AS INT), CAST(floor(({high}) / {step}) AS INT))) AS block")
    near = join_same(reach, listed, ["phrase", *DOC, "block"], "inner").where("at BETWEEN low AND high")
    whole = near.groupBy(*place, "n", "low").agg(F.collect_set(F.struct("at", "term")).alias("found")).where(
        f"exists(sequence(low, least(pos, other)), s -> size(array_distinct(transform("
        f"filter(found, y -> y.at BETWEEN s AND s + {within}), y -> y.term))) = n - 2)")
    return pairs.where("n = 2").select(*place).union(whole.select(*place)).union(one.select(*place).distinct())


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text", width: int = 10) -> DataFrame:
    """Per document: _id, _th, n_words, n_hit, items (sorted ids of the items of which a window occurs).

    A window is ``width`` consecutive words of an item, or all words of a shorter one.
    A word is hit if it lies in any occurrence.  Null, empty and wordless texts have no words and
    hit nothing; items without words are no windows; an item's repeated rows count once, and items
    without an id hit words but are not listed.  Rows that agree in id and text are repeats of
    one document, and each has its row in the result.  Empty tables give no rows, or no hits.
    """
    items = pin(_items(benchmark, item_id, item_text))
    terms = items.select(F.explode("item_words").alias("term"))
    postings = build_index(docs, id_col, text_col, terms)
    hits = phrase_hits(docs, postings, benchmark, id_col, text_col, item_id, item_text, width)
    named = join_checked(hits, pin(items.select("_item", "item_id").distinct().groupBy("_item").agg(
        F.collect_set("item_id").alias("ids"))), ["_item"], "left")
    per_doc = named.groupBy(*DOC).agg(
        F.size(F.array_distinct(F.flatten(F.collect_list(F.expr(
            "flatten(transform(starts, s -> sequence(s, s + length - 1)))"))))).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("items"))
    lengths = postings.where(F.col("term") == LENGTH).select(*DOC, F.col("pos").cast("long").alias("n_words"))
    return join_same(lengths, per_doc, DOC, "left").select(
        *DOC, "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))
