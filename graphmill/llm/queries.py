"""The problems' queries and, where SQL can express them, the SQL they must agree with."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import MISSING, folded, is_real
from ..scale import skew_join
from ..session import materialize
from . import blocks, bpe, components, leaks, lookalike, quantiles, quotas, survivors

QS = [0.05, 0.25, 0.5, 0.75, 0.95]
SCORES = ["kruskal_stress", "node_uniformity"]
MEASURES = [*SCORES, "n_nodes"]


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """(group_id, graph_id) of every linked graph."""
    return components.connected_groups(_read(spark, sf, "dedup_audit"), "dropped_graph_id", "kept_graph_id").withColumnRenamed("id", "graph_id")


def p1_groups(spark: SparkSession, sf: str) -> DataFrame:
    """For each group its size and how many of its graphs the manifest has."""
    known = _read(spark, sf, "manifest").select("graph_id", F.lit(1).alias("known")).distinct()
    found = p1_found(spark, sf).join(known, "graph_id", "left")
    return found.groupBy("group_id").agg(F.count("*").alias("n_graphs"), F.count("known").alias("n_in_manifest"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Groups with one row that is best in all measures, and that row."""
    return survivors.clear_winners(_read(spark, sf, "manifest"), _read(spark, sf, "sources"))


def p2_survivors(spark: SparkSession, sf: str) -> DataFrame:
    """One surviving row for each graph, built field by field."""
    return survivors.survivors(_read(spark, sf, "manifest"), _read(spark, sf, "sources"))


def _scored_by_key(spark: SparkSession, sf: str, keys: tuple[str, ...]) -> DataFrame:
    """(run_day, by, key, scores, n_nodes): every row of metrics once for each of the keys. A graph's source and n_nodes are
    those of its last manifest row; a missing key is '(none)'."""
    source = F.when(is_real(F.col("source")), folded(F.col("source"))).otherwise(F.lit("(none)"))
    last = _read(spark, sf, "manifest").groupBy("graph_id").agg(F.max_by(F.struct(source.alias("source"), "n_nodes"), "row_id").alias("m"))
    drawn = skew_join(_read(spark, sf, "metrics").select("graph_id", "layout", "run_day", *SCORES), last, ["graph_id"], "left")
    of = {"layout": F.coalesce("layout", F.lit("(none)")), "source": F.coalesce("m.source", F.lit("(not in manifest)")), "run_day": F.coalesce(F.col("run_day").cast("string"), F.lit("(none)"))}
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("by"), of[k].alias("key")) for k in keys)))
    return drawn.select("run_day", *SCORES, F.col("m.n_nodes").alias("n_nodes"), pairs.alias("k")).select("run_day", "k.by", "k.key", *SCORES, "n_nodes")


def p3_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles of each score, and of n_nodes of the drawn graphs, by layout, by source and by run_day.

    Sketches are made for single days (by layout and by source) and then joined into those of all days; those of
    one day's layouts make the day's. A graph's source and n_nodes are those of its last manifest row.
    """
    daily = materialize(quantiles.sketches(_scored_by_key(spark, sf, ("layout", "source")), ["run_day", "by", "key"], MEASURES))
    of_days = daily.filter("by = 'layout'").select(F.lit("run_day").alias("by"), F.coalesce(F.col("run_day").cast("string"), F.lit("(none)")).alias("key"), "measure", "state")
    return quantiles.percentiles(quantiles.merged(daily.drop("run_day").unionByName(of_days), ["by", "key"]), ["by", "key"], QS)


def p3_within_error(spark: SparkSession, sf: str) -> DataFrame:
    """For every key and measure of p3_percentiles: the exact number of values, and whether each of its percentiles has a
    rank, counted in the tables, within the stated error."""
    names = [f"p{round(100 * q):02d}" for q in QS]
    guesses = p3_percentiles(spark, sf).groupBy("by", "key").agg(F.map_from_entries(F.collect_list(F.struct("measure", F.struct("n", *names)))).alias("g"))
    met = skew_join(_scored_by_key(spark, sf, ("layout", "source", "run_day")), materialize(guesses), ["by", "key"])
    slack, counts = F.lit(2.0**-quantiles.MANTISSA), []
    for i, m in enumerate(MEASURES):
        v = F.nanvl(F.col(m).cast("double"), F.lit(None))
        counts += [F.count(v).alias(f"n{i}"), F.first(F.col("g")[m]).alias(f"g{i}")]
        for p in names:
            x = F.col("g")[m][p]
            counts += [F.count_if(v < x).alias(f"lt{i}{p}"), F.count_if(v <= x + F.abs(x) * slack).alias(f"le{i}{p}")]
    got = met.groupBy("by", "key").agg(*counts)
    checks = []
    for i, m in enumerate(MEASURES):
        n = F.col(f"n{i}")
        ok = n == F.col(f"g{i}")["n"]
        for q, p in zip(QS, names, strict=True):
            rank, slip = F.floor(F.lit(q) * (n - 1)), n * quantiles.RANK_ERROR + 1
            ok = ok & (F.col(f"lt{i}{p}") <= rank + slip) & (F.col(f"le{i}{p}") > rank - slip)
        checks.append(F.struct(F.lit(m).alias("measure"), n.alias("n"), F.coalesce(ok, F.lit(False)).alias("within_error")))
    return got.select("by", "key", F.explode(F.array(*checks)).alias("c")).select("by", "key", "c.*").filter("n > 0")


def _p4(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return _read(spark, sf, "manifest"), _read(spark, sf, "sample_targets")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Targets that cannot be met."""
    return quotas.unmet(*_p4(spark, sf))


def p4_report(spark: SparkSession, sf: str) -> DataFrame:
    """Every target's allotment and whether it could be met."""
    return quotas.allotted(*_p4(spark, sf))


def p4_sample(spark: SparkSession, sf: str) -> DataFrame:
    """The sample."""
    return quotas.sample(*_p4(spark, sf))


def p5_sample(spark: SparkSession, sf: str) -> DataFrame:
    """The stable sample of graphs."""
    return blocks.stable_sample(_read(spark, sf, "manifest"))


def p5_source_sample(spark: SparkSession, sf: str) -> DataFrame:
    """The stable sample within each source."""
    return blocks.stable_sample_by_source(_read(spark, sf, "manifest"))


def p5_growth(spark: SparkSession, sf: str) -> DataFrame:
    """For each run: how many graphs a sample taken after it had held, and how many of them the sample of all runs keeps."""
    whole = _read(spark, sf, "manifest").select("graph_id", "run_no", "row_id", "source")
    half = whole.filter(F.col("run_no") <= 6)
    parts = []
    for name, take, on in (("all", blocks.stable_sample, ["graph_id"]), ("by_source", blocks.stable_sample_by_source, ["source", "graph_id"])):
        now = take(whole).select(*on, F.lit(1).alias("kept"))
        parts.append(take(half).join(now, on, "left").agg(F.lit(name).alias("sample"), F.count("*").alias("n_before"), F.count("kept").alias("n_kept")))
    return parts[0].unionByName(parts[1])


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.token_ids(_read(spark, sf, "documents"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with the items that leaked into them."""
    return leaks.leaked_items(_read(spark, sf, "documents"), _read(spark, sf, "eval_items"))


def p7_items(spark: SparkSession, sf: str) -> DataFrame:
    """For each item its suite and the number of documents it leaked into."""
    items = _read(spark, sf, "eval_items").select("item_id", "suite")
    return items.join(p7_found(spark, sf).groupBy("item_id").agg(F.count("*").alias("n_docs")), "item_id", "left").fillna(0, ["n_docs"])


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of documents that look the same but differ."""
    return lookalike.lookalike_pairs(_read(spark, sf, "documents")).select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p8_classes(spark: SparkSession, sf: str) -> DataFrame:
    """For each document with a visible text the class of those that look the same, and how many texts and rows that has."""
    return lookalike.lookalike_classes(_read(spark, sf, "documents"))


def p8_text(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's text in the consistent form."""
    return lookalike.canonical_text(_read(spark, sf, "documents"), keep=["doc_id"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries by name."""
    names = (p1_found, p1_groups, p2_found, p2_survivors, p3_percentiles, p3_within_error, p4_found, p4_report, p4_sample, p5_sample, p5_source_sample, p5_growth, p6_ids, p7_found, p7_items, p8_found, p8_classes, p8_text)
    return {f.__name__: f for f in names}


_STRIP = r"regexp_replace(regexp_replace({c}, '^[\s\p{{Z}}]+', ''), '[\s\p{{Z}}]+$', '')"


def _fold(c: str) -> str:
    return "lower(" + _STRIP.format(c=c) + ")"


def _real(c: str) -> str:
    return f"coalesce({_fold(c)} NOT IN ({', '.join(repr(x) for x in MISSING)}), false)"


_GROUPS = """WITH RECURSIVE e AS (
  SELECT DISTINCT dropped_graph_id AS a, kept_graph_id AS b FROM dedup_audit WHERE dropped_graph_id <> kept_graph_id),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS id, a AS seen FROM s UNION SELECT r.id, s.b FROM r JOIN s ON r.seen = s.a),
found AS (SELECT min(seen) AS group_id, id AS graph_id FROM r GROUP BY id)
"""

_SCORED = f"""WITH t AS (SELECT {_fold("source")} AS s, max(coalesce(trust, 0)) AS trust FROM sources GROUP BY 1),
m AS (SELECT a.*, CASE WHEN {_real("a.category")} THEN 1 ELSE 0 END + CASE WHEN {_real("a.source")} THEN 1 ELSE 0 END + CASE WHEN {_real("a.generator")} THEN 1 ELSE 0 END AS n_real,
  CASE WHEN {_real("a.source")} THEN coalesce(t.trust, 0) ELSE 0 END AS trust,
  coalesce(generated_at_utc, TIMESTAMP '0001-01-01') AS seen_at
  FROM manifest a LEFT JOIN t ON {_fold("a.source")} = t.s)
"""


def _filled(c: str) -> str:
    return f"coalesce(max(CASE WHEN n = 1 AND {_real(c)} THEN {c} END), arg_max({c}, (trust, seen_at, -row_id)) FILTER (WHERE {_real(c)})) AS {c}"


_MEMBERS = f"""members AS (SELECT DISTINCT t.target_id, m.graph_id FROM manifest m JOIN sample_targets t ON {_fold("m.source")} = {_fold("t.source")}
  WHERE m.n_nodes BETWEEN t.n_lo AND t.n_hi AND m.density >= t.density_lo AND m.density < t.density_hi AND m.density::VARCHAR NOT IN ('nan', '-nan') AND m.graph_id IS NOT NULL),
assigned AS (SELECT graph_id, min(target_id) AS target_id FROM members GROUP BY 1),
base AS (SELECT t.target_id, t.source, coalesce({_fold("t.source")}, '') AS s, n_lo, n_hi,
    greatest(coalesce(t.floor_rows, 0), floor(coalesce(t.target_share, 0) * (SELECT count(DISTINCT graph_id) // 20 FROM manifest) + 0.5))::BIGINT AS want,
    (SELECT count(*) FROM members x WHERE x.target_id = t.target_id) AS available,
    (SELECT count(*) FROM assigned x WHERE x.target_id = t.target_id) AS drawable
  FROM sample_targets t),
k0 AS (SELECT *, least(want, drawable) AS own, want - least(want, drawable) AS short, want - least(want, drawable) AS left_over, drawable - least(want, drawable) AS spare FROM base),
""" + ",\n".join(
    f"""m{i} AS (SELECT *, least(sum(left_over) OVER a, sum(spare) OVER a) AS moved, sum(spare) OVER a AS all_spare, sum(left_over) OVER a AS all_left, sum(spare) OVER u AS upto_spare, sum(left_over) OVER u AS upto_left
    FROM k{i} WINDOW a AS ({part}), u AS ({part} ORDER BY s, target_id)),
f{i} AS (SELECT * EXCLUDE (moved, all_spare, all_left, upto_spare, upto_left),
    (CASE WHEN all_spare > 0 THEN (upto_spare * moved) // all_spare - ((upto_spare - spare) * moved) // all_spare ELSE 0 END)::BIGINT AS from_{kin},
    (CASE WHEN all_left > 0 THEN (upto_left * moved) // all_left - ((upto_left - left_over) * moved) // all_left ELSE 0 END)::BIGINT AS to_{kin} FROM m{i}),
k{i + 1} AS (SELECT * REPLACE (spare - from_{kin} AS spare, left_over - to_{kin} AS left_over) FROM f{i})"""
    for i, (kin, part) in enumerate((("siblings", "PARTITION BY s, n_lo, n_hi"), ("cousins", "PARTITION BY s"), ("others", "")))
) + """,
allotted AS (SELECT *, (own + from_siblings + from_cousins + from_others)::BIGINT AS allotted, left_over AS unfilled, available >= want AS met FROM k3)
"""


def _hex(text: str) -> str:
    """The number that the first eight digits of an md5 write, in SQL."""
    digits = " + ".join(f"(instr('123456789abcdef', substr(md5({text}), {i + 1}, 1)))::BIGINT * {16 ** (7 - i)}" for i in range(8))
    return f"({digits})"


def _chosen(table: str, columns: str, head: str) -> str:
    """Floyd's choice, step by step."""
    tops = range(blocks.BLOCK - blocks.PICKS, blocks.BLOCK)
    sql = f"q0 AS (SELECT *, seq // {blocks.BLOCK} AS b, seq % {blocks.BLOCK} AS place FROM {table})"
    for k, top in enumerate(tops):
        drawn = _hex(f"{head} || '|' || b::VARCHAR || '|{top}'") + f" % {top + 1}"
        clash = " OR ".join([f"c{j} = {drawn}" for j in range(k)]) or "false"
        sql += f", q{k + 1} AS (SELECT *, CASE WHEN {clash} THEN {top} ELSE {drawn} END AS c{k} FROM q{k})"
    return f"{sql} SELECT {columns} FROM q{blocks.PICKS} WHERE place IN ({', '.join(f'c{k}' for k in range(blocks.PICKS))})"


_FIRST = f"""WITH f AS (SELECT graph_id, run_no, row_id, CASE WHEN {_real("source")} THEN {_fold("source")} ELSE '(none)' END AS source
  FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY run_no, row_id) AS n FROM manifest WHERE graph_id IS NOT NULL AND run_no IS NOT NULL AND row_id IS NOT NULL) WHERE n = 1)
"""


#: Characters that look the same, each word beginning with the one that stands for all. Written down for the SQL
#: alone, letter by letter, beside the operator's lists by alphabet.
_ALIKE = (
    "AΑАᎪⲀꓮ BΒВᏴⲂꓐ CСϹᏟⲤꓚ DᎠꓓ EΕЕᎬꓰ Fꓝ GԌᏀꓖ HΗНᎻⲎꓧ IΙІⲒꓲ JЈᎫꓙ KΚКᏦⲔꓗ LᏞꓡ MΜМᎷⲘꓟ NΝⲚꓠ OΟОՕⲞꓳ PΡРᏢⲢꓑ QԚ RᎡꓣ SЅՏᏚꓢ TΤТᎢⲦꓔ UՍꓴ VᏙꓦ WԜᏔᎳꓪ XΧХⲬꓫ YΥҮⲨꓬ ZΖᏃⲌꓜ "
    "aаɑ cсϲᴄⲥ dԁꓒ eе gɡց hһհ iіᎥ jјϳ lӏ nո oοоօᴏⲟ pрρⲣ qԛզ sѕꜱ uսᴜ vνѵᴠ wԝᴡ xхⲭ yу zᴢ ГΓᎱⲄ ПΠⲠ ФΦⲪ ѰΨⲮ гᴦ пᴨ лᴫ кκᴋĸ вʙ мᴍ нʜ тᴛ"
)
_DRAWN_CF = (*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD)


@functools.cache
def _standing() -> dict[str, str]:
    return {ch: word[0] for word in _ALIKE.split() for ch in word[1:]}


@functools.cache
def _shown() -> dict[str, str]:
    """What each single character is shown as, from the Unicode data: its plain form if only width, form, font or breaking
    differ, its look-alikes' letter, a blank for every kind of blank. Others are shown as they are."""
    out, kinds = {}, {"<wide>", "<narrow>", "<noBreak>", "<font>", "<isolated>", "<initial>", "<medial>", "<final>"}
    for x in (*range(0x80, 0xD800), *range(0xF900, 0x20000), *range(0x2F800, 0x2FA20)):
        ch = chr(x)
        kind = unicodedata.decomposition(ch).split(" ")[0]
        if unicodedata.category(ch) == "Zs":
            to = " "
        elif kind in kinds or ch == "µ" or kind == "<compat>" and ch != "ſ" and unicodedata.normalize("NFKD", ch).isascii() and unicodedata.normalize("NFKD", ch).isalpha():
            to = unicodedata.normalize("NFKD", ch)
        else:
            to = unicodedata.normalize("NFD", ch)
        to = unicodedata.normalize("NFC", "".join(_standing().get(y, y) for y in to))
        if to != ch:
            out[ch] = to
    return out


@functools.cache
def _look(c: str) -> str:
    """SQL of the consistent form of c: one character for one by translate(), the few that become several by replacement, those
    without a look by pattern, then the database composes the marks."""
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    sql = f"replace(replace({c}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    sql = rf"regexp_replace({sql}, '[\x{{b}}\x{{c}}\x{{85}}\x{{2028}}\x{{2029}}]', chr(10), 'g')"
    unseen = "".join(chr(x) for x in range(0x80, 0xE0200) if unicodedata.category(chr(x)) == "Cf" and x not in _DRAWN_CF)
    sql = rf"regexp_replace({sql}, '[{unseen}\x{{0}}-\x{{8}}\x{{e}}-\x{{1f}}\x{{7f}}-\x{{9f}}\x{{34f}}\x{{115f}}\x{{1160}}\x{{17b4}}\x{{17b5}}\x{{180b}}-\x{{180d}}\x{{180f}}\x{{3164}}\x{{fe00}}-\x{{fe0f}}\x{{ffa0}}\x{{e0100}}-\x{{e01ef}}]', '', 'g')"
    one = [(a, b) for a, b in _shown().items() if len(b) == 1]
    for ch, to in _shown().items():
        if 1 < len(to) and (to.isascii() or 0x300 <= ord(ch) < 0x3400):
            sql = f"replace({sql}, {quote(ch)}, {quote(to)})"
    return f"nfc_normalize(translate({sql}, {quote(''.join(a for a, _ in one))}, {quote(''.join(b for _, b in one))}))"


def _words(c: str) -> str:
    """SQL of the words of a text, as a list, without case."""
    small = {}
    for x in range(0x80, 0x2E00):
        ch = chr(x)
        if ch.isalpha() and ch == ch.lower():
            low = _standing().get(ch, ch).lower()
            up = low.upper()
            low = _standing()[up].lower() if up in _standing() else low
            if low != ch:
                small[ch] = low
    lower = f"translate(lower(regexp_replace({_look(c)}, '{leaks.TAG}', ' ', 'g')), '{''.join(small)}', '{''.join(small.values())}')"
    return f"regexp_extract_all({lower}, '[\\p{{L}}\\p{{N}}]+')".replace("\\\\", "\\")


def _grams(table: str, key: str) -> str:
    n = leaks.WORDS
    return f"SELECT {key}, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS gram FROM (SELECT {key}, {_words('text')} AS w FROM {table} WHERE text IS NOT NULL) WHERE len(w) >= {n}"


def sql() -> dict[str, str]:
    """SQL for the queries that it can express; p3_percentiles and p6 are tested by brute force."""
    leaked = f"WITH found AS (SELECT DISTINCT doc_id, item_id FROM ({_grams('documents', 'doc_id')}) a JOIN ({_grams('eval_items', 'item_id')}) b ON a.gram = b.gram)"
    forms = f"f AS (SELECT doc_id, text, {_look('text')} AS form FROM documents)"
    by_source = "SELECT source, graph_id, row_number() OVER (PARTITION BY source ORDER BY run_no, row_id, graph_id) - 1 AS seq FROM f"
    return {
        "p1_found": _GROUPS + "SELECT group_id, graph_id FROM found",
        "p1_groups": _GROUPS + "SELECT group_id, count(*) AS n_graphs, count(*) FILTER (WHERE graph_id IN (SELECT graph_id FROM manifest)) AS n_in_manifest FROM found GROUP BY 1",
        "p2_found": _SCORED + """, g AS (SELECT prop_hash, count(*) AS n, max(n_real) AS r, max(trust) AS t, max(seen_at) AS a FROM m WHERE prop_hash IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
            SELECT m.prop_hash, max(m.row_id) AS row_id FROM m JOIN g ON m.prop_hash = g.prop_hash AND m.n_real = g.r AND m.trust = g.t AND m.seen_at = g.a GROUP BY 1 HAVING count(*) = 1""",
        "p2_survivors": _SCORED + f""", k AS (SELECT *, coalesce(prop_hash, 'row ' || row_id) AS key, prop_hash IS NULL AS alone FROM m),
            x AS (SELECT *, row_number() OVER (PARTITION BY key, alone ORDER BY n_real DESC, trust DESC, seen_at DESC, row_id) AS n FROM k)
            SELECT max(prop_hash) AS prop_hash, max(CASE WHEN n = 1 THEN row_id END) AS row_id, {_filled("graph_id")}, {_filled("category")}, {_filled("source")}, {_filled("generator")}, count(*) AS n_rows
            FROM x GROUP BY key, alone""",
        "p3_within_error": f"""WITH g AS (SELECT graph_id, CASE WHEN {_real("source")} THEN {_fold("source")} ELSE '(none)' END AS source, n_nodes FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY row_id DESC) AS r FROM manifest) WHERE r = 1),
            d AS (SELECT coalesce(layout, '(none)') AS layout, coalesce(source, '(not in manifest)') AS source, coalesce(run_day::VARCHAR, '(none)') AS run_day, {", ".join(f"CASE WHEN {m}::VARCHAR NOT IN ('nan', '-nan') THEN {m} END AS {m}" for m in SCORES)}, n_nodes FROM metrics m LEFT JOIN g ON m.graph_id = g.graph_id)
            """ + " UNION ALL ".join(f"SELECT '{k}' AS by, {k} AS key, '{m}' AS measure, count({m}) AS n, true AS within_error FROM d GROUP BY {k} HAVING count({m}) > 0" for k in ("layout", "source", "run_day") for m in MEASURES),
        "p4_found": f"WITH {_MEMBERS} SELECT target_id FROM allotted WHERE available < want",
        "p4_report": f"WITH {_MEMBERS} SELECT target_id, source, want, available, drawable, own, from_siblings, from_cousins, from_others, allotted, short, to_siblings, to_cousins, to_others, unfilled::BIGINT AS unfilled, met FROM allotted",
        "p4_sample": f"""WITH {_MEMBERS}, ranked AS (SELECT target_id, graph_id, dense_rank() OVER (PARTITION BY target_id ORDER BY md5('p4|' || graph_id)) AS r FROM assigned)
            SELECT ranked.target_id, graph_id FROM ranked JOIN allotted USING (target_id) WHERE r <= allotted""",
        "p5_sample": _FIRST + ", s AS (SELECT graph_id, row_id AS seq FROM f), " + _chosen("s", "graph_id, seq", "'p5'"),
        "p5_source_sample": _FIRST + f", s AS ({by_source}), " + _chosen("s", "source, graph_id, seq", "'p5s|' || source"),
        "p7_found": f"{leaked} SELECT doc_id, item_id FROM found",
        "p7_items": f"{leaked} SELECT item_id, suite, (SELECT count(*) FROM found WHERE found.item_id = e.item_id) AS n_docs FROM eval_items e",
        "p8_found": f"WITH {forms} SELECT DISTINCT least(a.doc_id, b.doc_id) AS doc_id_a, greatest(a.doc_id, b.doc_id) AS doc_id_b FROM f a JOIN f b ON a.form = b.form AND a.doc_id < b.doc_id AND a.text <> b.text WHERE regexp_matches(a.form, '[^ \\t\\n]')",
        "p8_classes": f"WITH {forms}, c AS (SELECT form, min(doc_id) AS class_id, count(DISTINCT text) AS n_texts, count(*) AS n_rows FROM f WHERE regexp_matches(form, '[^ \\t\\n]') GROUP BY 1) SELECT doc_id, class_id, n_texts, n_rows FROM f JOIN c ON f.form = c.form",
        "p8_text": f"WITH {forms} SELECT doc_id, form AS canonical FROM f",
        "p5_growth": "SELECT 'all' AS sample, n AS n_before, n AS n_kept FROM (" + (_FIRST + ", s AS (SELECT graph_id, row_id AS seq FROM f WHERE run_no <= 6), " + _chosen("s", "count(*) AS n", "'p5'")) + ") UNION ALL SELECT 'by_source', n, n FROM (" + (_FIRST + f", s AS ({by_source} WHERE run_no <= 6), " + _chosen("s", "count(*) AS n", "'p5s|' || source")) + ")",
    }
