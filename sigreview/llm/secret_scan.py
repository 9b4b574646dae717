"""Secret scans by two character Markov models, beside fixed patterns.

One model holds how characters follow each other in random strings, the other how they do in ordinary
identifiers; both are counted from labelled samples.  A run of token characters is a secret
where the log-likelihood ratio of the two says so.  All of it is DataFrame work: a model is a
few thousand numbers, written into the plan as one array.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pin

#: The fixed patterns, in the order in which spans at one place are listed.
BASE = (
    ("assign", "(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"),
    ("access", "AKIA[A-Z0-9]+"),
    ("hex", "[0-9a-f]{16,}"),  # the runs of 16 and more among all runs: these are maximal either way
)
#: Least characters: of an assignment's value, and of an access key.
ASSIGN_CHARS, ACCESS_CHARS = 12, 18
MARKOV = "markov"

#: Characters of the models; pairs are numbered by their places here.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-="
# Runs that the models judge, and runs that stand for ordinary identifiers in training.
RUN = "[A-Za-z0-9+/_=-]{12,}"
IDENTIFIER = "[A-Za-z0-9_-]{8,}"
# A secret: at least so much log-likelihood ratio in all, and for each pair of characters.
LEAST_TOTAL, LEAST_PAIR = 12.0, 0.6
# Pairs that the general frequency of second characters counts for after each first one.
PRIOR_PAIRS = 20
# Part of the model of random strings that is uniform: samples may hold one kind of secret only.
UNIFORM = 0.5
# Bound of the labelled sample: documents that it is taken from, those with the least hash of the id.
SAMPLE_DOCS = 4000


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


_SPANS = "ARRAY<STRUCT<start: INT, ord: INT, end: INT, kind: STRING, value: STRING>>"
_BLOCK = 256


def _let(value: str, name: str, body: str) -> str:
    """SQL for ``body`` in which ``name`` is ``value``, computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _sums_before(numbers: str) -> str:
    """SQL for the sum before each element of a non-empty array of integers.

    Sums are taken in blocks, then over the blocks' sums, so a long array costs a block's length for each element.
    """
    add = "0, (p, q) -> p + q"
    starts = _let(f"transform(b, v -> aggregate(v, {add}))", "t", f"transform(t, (y, i) -> aggregate(slice(t, 1, i), {add}))")
    inside = f"flatten(zip_with(b, {starts}, (v, s) -> transform(v, (y, i) -> s + aggregate(slice(v, 1, i), {add}))))"
    blocks = f"transform(sequence(0, CAST((size(x) - 1) DIV {_BLOCK} AS INT)), j -> slice(x, j * {_BLOCK} + 1, {_BLOCK}))"
    return _let(numbers, "x", _let(blocks, "b", inside))


def _matches(text: str, kind: str, pattern: str) -> str:
    """SQL for all matches in order, as structs of the text before one (`0`), the match (`1`) and its value (`2`)."""
    regex = _quoted(pattern)
    group = 2 if kind == "assign" else 0
    return (f"arrays_zip(slice(split({text}, {regex}, -1), 1, size(regexp_extract_all({text}, {regex}, 0))), "
            f"regexp_extract_all({text}, {regex}, 0), regexp_extract_all({text}, {regex}, {group}))")


def _found(text: str, order: int, kind: str, pattern: str) -> str:
    """SQL for all matches in order, as structs start, ord, end, kind, value; code points."""
    before = _sums_before("transform(z, m -> char_length(m.`0`) + char_length(m.`1`))")
    start = "at + char_length(m.`0`)"
    spans = _let(_matches(text, kind, pattern), "z", (
        f"zip_with(z, {before}, (m, at) -> named_struct('start', {start}, 'ord', {order}, "
        f"'end', {start} + char_length(m.`1`), 'kind', '{kind}', 'value', m.`2`))"))
    return f"CASE WHEN {text} RLIKE {_quoted(pattern)} THEN CAST({spans} AS {_SPANS}) ELSE CAST(array() AS {_SPANS}) END"


def _kept(kind: str, value: str) -> str:
    """SQL for whether a match of a fixed pattern counts, by its value."""
    least = {"assign": ASSIGN_CHARS, "access": ACCESS_CHARS}.get(kind, 0)
    return f"char_length({value}) >= {least}"


def _blanked(text: str, kind: str, pattern: str) -> str:
    """SQL for a text with the matches of a fixed pattern blanked, in their length."""
    blank = f"CASE WHEN {_kept(kind, 'm.`2`')} THEN repeat(' ', char_length(m.`1`)) ELSE m.`1` END"
    joined = f"array_join(transform({_matches(text, kind, pattern)}, m -> concat(m.`0`, {blank})), '')"
    return f"CASE WHEN {text} RLIKE {_quoted(pattern)} THEN concat({joined}, element_at(split({text}, {_quoted(pattern)}, -1), -1)) ELSE {text} END"


def base_spans(text: str) -> str:
    """SQL for the spans of the fixed patterns, failing matches dropped, by start and kind."""
    parts = [_found(text, k, kind, pattern) for k, (kind, pattern) in enumerate(BASE)]
    keep = "CASE s.kind " + " ".join(f"WHEN '{kind}' THEN {_kept(kind, 's.value')}" for kind, _ in BASE) + " END"
    return f"array_sort(filter(concat({', '.join(parts)}), s -> {keep}))"


def _pairs(chars: str) -> str:
    """SQL for the numbers of the pairs of neighbouring characters in an array of characters."""
    n = len(ALPHABET)
    place = lambda c: f"instr('{ALPHABET}', {c})"
    return (f"zip_with(slice({chars}, 1, size({chars}) - 1), slice({chars}, 2, size({chars}) - 1), "
            f"(a, b) -> ({place('a')} - 1) * {n} + {place('b')})")


def samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE_DOCS) -> DataFrame:
    """Labelled strings (value, secret) from at most ``most`` documents: values of the fixed patterns
    are random strings, the runs of letters and digits in texts without any are identifiers."""
    text = F.coalesce(text_col, F.lit("")).alias("_text")
    ids = docs.select(F.col(id_col).alias("_id")).where("_id IS NOT NULL").distinct().orderBy(F.xxhash64("_id"), "_id").limit(most)
    # The sample is written before it is looked through: patterns run over it alone, and once.
    texts = pin(docs.select(F.col(id_col).alias("_id"), text).join(F.broadcast(ids), "_id").select("_text"))
    spans = pin(texts.selectExpr("_text", f"{base_spans('_text')} AS spans"))
    secret = spans.where("size(spans) > 0").selectExpr("explode(spans.value) AS value", "true AS secret")
    plain = spans.where("size(spans) = 0").selectExpr(f"explode(regexp_extract_all(_text, '{IDENTIFIER}', 0)) AS value", "false AS secret")
    return secret.unionByName(plain)


def train(labelled: DataFrame) -> list[float]:
    """The log-likelihood ratio of every pair of characters, from strings (value, secret).

    What follows a character is smoothed by ``PRIOR_PAIRS`` pairs dealt as all second characters
    are, and these by half a pair each; a random string is by half a uniform one.  Without samples of
    a kind all pairs count alike for it."""
    n = len(ALPHABET)
    pairs = labelled.where("value IS NOT NULL AND secret IS NOT NULL AND char_length(value) > 1").selectExpr(
        "secret", "split(value, '') AS chars").selectExpr("secret", f"explode({_pairs('chars')}) AS pair")
    counted = pin(pairs.where(f"pair BETWEEN 1 AND {n * n}").groupBy("pair").agg(
        F.count_if("secret").alias("random"), F.count_if(~F.col("secret")).alias("plain")))
    grid = labelled.sparkSession.range(1, n * n + 1).selectExpr(
        "CAST(id AS INT) AS pair", f"CAST((id - 1) DIV {n} AS INT) AS first", f"CAST((id - 1) % {n} AS INT) AS second")
    full = grid.join(counted, "pair", "left").fillna(0, ["random", "plain"])
    kinds = ("random", "plain")
    rows = full.groupBy("first").agg(*[F.sum(k).alias(f"{k}_row") for k in kinds])
    seconds = full.groupBy("second").agg(*[(F.sum(k) + 0.5).alias(f"{k}_second") for k in kinds])
    all_pairs = full.agg(*[F.sum(k).alias(k) for k in kinds]).first()
    likely = {k: f"(({k} + {PRIOR_PAIRS}D * {k}_second / {all_pairs[k] + 0.5 * n}D) / ({k}_row + {PRIOR_PAIRS}D))" for k in kinds}
    mixed = f"({1 - UNIFORM}D * {likely['random']} + {UNIFORM / n}D)"
    ratios = full.join(rows, "first").join(seconds, "second").selectExpr("pair", f"ln({mixed}) - ln({likely['plain']}) AS ratio")
    return [r["ratio"] for r in ratios.orderBy("pair").collect()]  # as many rows as there are pairs


def scan(docs: DataFrame, model: list[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col`` and spans, an array of structs (start, ord, end, kind, value) by start and kind.

    Whole texts of any length; null and empty texts have no spans.  Spans that the models add have the kind
    ``markov``: runs of at least 12 characters in what the fixed patterns leave uncovered, also beside their spans in
    one word.  The spans of the fixed patterns all stay.  Rows that repeat get the same spans; an empty table gives no rows;
    other columns play no part.
    """
    ratios = f"CAST(split('{','.join(f'{x:.6f}' for x in model)}', ',') AS ARRAY<DOUBLE>)"
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text"))
    found = rows.selectExpr("_id", "_text", f"{base_spans('_text')} AS base")
    for kind, pattern in BASE:
        found = found.selectExpr("_id", "base", f"CASE WHEN size(base) > 0 THEN {_blanked('_text', kind, pattern)} ELSE _text END AS _text")
    runs = found.selectExpr("_id", "base", f"{_found('_text', len(BASE), MARKOV, RUN)} AS runs")
    total = f"aggregate({_pairs('split(r.value, {e})').format(e=chr(39) * 2)}, 0D, (sum, p) -> sum + coalesce(element_at({ratios}, p), 0D))"
    pairs = "(char_length(r.value) - 1)"
    # Blanking one pattern can cut off a match of the next one, so what is left of it is still asked for here.
    free = "NOT exists(base, b -> b.start < r.end AND r.start < b.end)"
    added = f"filter(runs, r -> {total} >= greatest({LEAST_TOTAL}D, {LEAST_PAIR}D * {pairs}) AND {free})"
    return runs.selectExpr(f"_id AS `{id_col}`", f"array_sort(concat(base, {added})) AS spans")


def listed(spans: str) -> str:
    """SQL for kind:start:end of an array of spans, comma-joined."""
    return f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
