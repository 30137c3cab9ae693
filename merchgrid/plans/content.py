"""Queries over text quality, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from merchgrid.bind import Tables
from merchgrid.functions.common import half_up
from merchgrid.operators import quality as Q
from merchgrid.plans.sql import r, with_tables
from merchgrid.rules import quality as rules

_AXES = ["structure", "length", "anti_hype", "coverage", "fidelity", "total"]
_FACT = ["signal", "completeness", "specificity", "uniqueness", "total", "duplicate_blocks", "near_pairs", "collisions"]


def output_quality(spark, sf):
    return Q.output_quality(Tables(spark, sf).outputs()).select("handle", *[F.col(a).cast("bigint").alias(a) for a in _AXES])


def quality_rollup(spark, sf):
    q = Q.quality_rollup(Q.output_quality(Tables(spark, sf).outputs()))
    return q.select("outputs", *[half_up(F.col(c), 6).alias(c) for c in q.columns if c != "outputs"])


def fact_quality(spark, sf):
    return Q.fact_quality(Tables(spark, sf).facts()).select("handle", *[F.col(a).cast("bigint").alias(a) for a in _FACT])


def near_dup_pairs(spark, sf):
    d = Tables(spark, sf).raw("documents")
    return Q.near_duplicate_counts(d.select("doc_id", F.explode(F.split("text", "\n")).alias("line")), "doc_id")


def ngram_overlap(spark, sf):
    return Q.shared_ngrams(Tables(spark, sf).facts(), "handle")


def fallback_drafts(spark, sf):
    """Short drafts: 500 characters, 6 features of 100, 8 specifications."""
    f = Tables(spark, sf).facts()
    return f.select("handle", F.coalesce(Q.fallback_html(F.col("blocks"), F.col("bullets"), F.col("specs"), 500, 6, 100, 8), F.lit("")).alias("html"))


def fallback_drafts_whole(spark, sf):
    f = Tables(spark, sf).facts()
    return f.select("handle", F.coalesce(Q.fallback_html(F.col("blocks"), F.col("bullets"), F.col("specs")), F.lit("")).alias("html"))


def boilerplate_lines(spark, sf):
    d = Tables(spark, sf).raw("documents").select("lang", F.explode(F.split("text", "\n")).alias("line"))
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("lines"), F.count_if(Q.is_boilerplate(F.col("line"))).alias("boilerplate"))


def output_confidence(spark, sf):
    o = Tables(spark, sf).outputs()
    n = F.col("doc_id")
    warn = F.when(n % 6 == 0, F.array(F.lit("NO_IMAGES_FOUND"), F.lit("LOW_COLOR_OVERLAP"))).when(n % 4 == 0, F.array(F.lit("X"))).otherwise(F.array().cast("array<string>"))
    sources = (F.col("ld_description") != "").cast("int") + (F.size("bullets") > 0).cast("int") + (F.size("specs") > 0).cast("int")
    c = Q.output_confidence(F.col("body_html"), (n % 8).cast("int"), (n % 5).cast("int"), warn, sources)
    return o.select("handle", c.cast("bigint").alias("confidence"))


QUERIES = {f.__name__: f for f in (output_quality, quality_rollup, fact_quality, near_dup_pairs, ngram_overlap, fallback_drafts, fallback_drafts_whole, boilerplate_lines, output_confidence)}

# ---------------------------------------------------------------- oracles
_W = lambda c: f"list_filter(regexp_split_to_array({c}, '\\s+'), lambda zz: zz <> '')"
_LONG = lambda c: f"list_filter(regexp_split_to_array(lower({c}), '\\s+'), lambda zz: length(zz) > 4)"
_USED = lambda c, lim, need: (
    f"(len({_LONG(c)}[1:{lim}]) > 0 AND len(list_filter({_LONG(c)}[1:{lim}], lambda yy: contains(body, yy))) >= least({need}, len({_LONG(c)}[1:{lim}])))")
_BOUND = lambda w: f"(^|[^\\p{{L}}\\p{{N}}_]){w}($|[^\\p{{L}}\\p{{N}}_])"
_BANNED = " + ".join(f"regexp_matches(body, '{_BOUND(w)}')::INT" for w in rules.BANNED_WORDS)
_BOIL = "(?i)(?:" + ")|(?:".join(p.replace("'", "''") for p in rules.BOILERPLATE) + ")"
_ISBOIL = lambda c: f"(regexp_matches({c}, '{_BOIL}') OR (length(regexp_replace({c}, '^\\s+|\\s+$', '', 'g')) < 15 AND NOT regexp_matches({c}, '\\d') AND NOT regexp_matches({c}, '[A-Z]{{2,}}')))"
_FOLD = lambda c: f"regexp_replace({c}, '[À-ÖØ-öø-ÿ]', '_', 'g')"
_GRAMS = lambda c: (
    f"list_distinct(flatten(list_transform(list_filter(list_transform({c}, lambda ln: {_W('lower(ln)')}), lambda ws: len(ws) >= 6), lambda w: list_transform(range(1, len(w) - 4), lambda i: array_to_string(w[i:i + 5], ' ')))))")

_OUT = {
    "o1": f"""SELECT *, lower(regexp_replace(body_html, '<[^>]+>', ' ', 'g')) AS body, list_transform(regexp_extract_all(body_html, '([^<>]*)</li>', 1), lambda x: trim(x)) AS li,
        contains(body_html, '<p>') AS p_, contains(body_html, '<ul>') AS ul_, contains(body_html, '<table>') AS tb_, contains(body_html, '<h3>') AS h_,
        len({_W("regexp_replace(body_html, '<[^>]+>', ' ', 'g')")}) AS nw FROM outputs""",
    "o2": f"""SELECT *, len(li) AS nli, len(list_filter(li, lambda x: len({_W('x')}) > 12)) AS longli, {_BANNED} AS banned,
        p_::INT + h_::INT + (ul_ OR len(bullets) = 0)::INT + (tb_ OR len(specs) = 0)::INT AS sem,
        len(list_filter(bullets, lambda x: {_USED('x', 5, 2)})) AS bu, len(list_filter(blocks, lambda x: {_USED('x', 10, 3)})) AS blu,
        (len(specs) > 0)::INT + (materials <> '')::INT + (care <> '')::INT AS nrich,
        (len(specs) > 0 AND len(list_filter(specs, lambda x: contains(body, lower(x)))) > 0)::INT + (materials <> '' AND {_USED('materials', 10, 2)})::INT + (care <> '' AND {_USED('care', 10, 2)})::INT AS nused FROM o1""",
    "o3": """SELECT handle, (CASE WHEN p_ THEN 8 ELSE 0 END + CASE WHEN len(bullets) = 0 THEN 7 WHEN NOT ul_ THEN 0 WHEN nli <= 6 THEN 7 ELSE 3 END
          + CASE WHEN len(specs) = 0 OR tb_ THEN 5 ELSE 0 END + least(5, floor(sem * 5 / 4.0::DOUBLE)))::BIGINT AS structure,
        (CASE WHEN nw BETWEEN 100 AND 400 THEN 10 WHEN nw BETWEEN 50 AND 600 THEN 5 ELSE 0 END + CASE WHEN nli = 0 OR longli = 0 THEN 5 ELSE floor(5 * (1 - longli::DOUBLE / nli)) END)::BIGINT AS length,
        greatest(0, 15 - least(15, banned * 5))::BIGINT AS anti_hype,
        (CASE WHEN len(blocks) = 0 OR blu > 0 THEN 5 ELSE 0 END + CASE WHEN len(bullets) = 0 THEN 5 ELSE floor(5 * (bu::DOUBLE / len(bullets))) END
          + CASE WHEN nrich = 0 THEN 5 ELSE floor(5 * (nused::DOUBLE / nrich)) END)::BIGINT AS coverage,
        (CASE WHEN quality IS NULL THEN 0 WHEN ns + nu + ne = 0 THEN 30 ELSE floor(30 * (ns::DOUBLE / (ns + nu + ne))) END)::BIGINT AS fidelity FROM o2""",
    "o4": "SELECT *, structure + length + anti_hype + coverage + fidelity AS total FROM o3",
}
_PAIRS = lambda src, key: {
    "ls": f"SELECT {key}, list_sort(list_distinct({_W('lower(line)')})) AS s, row_number() OVER () AS rid FROM {src}",
    "lp": f"""SELECT a.{key}, count(*) AS pairs FROM ls a JOIN ls b ON a.{key} = b.{key} AND a.rid < b.rid AND len(a.s) > 0 AND len(b.s) > 0
        WHERE len(list_intersect(a.s, b.s))::DOUBLE / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) > 0.7 GROUP BY 1""",
}
_FACTS = {
    "f1": f"SELECT *, list_filter(blocks, lambda x: NOT {_ISBOIL('x')}) AS rb, list_filter(bullets, lambda x: NOT {_ISBOIL('x')}) AS rf FROM facts",
    "bullet_lines": "SELECT handle, unnest(rf) AS line FROM f1",
    "f2": f"""SELECT f1.*, coalesce(pairs, 0) AS near_pairs, array_to_string(list_concat(rb, rf), ' ') AS content,
        CASE WHEN len(blocks) + len(bullets) = 0 THEN 0.0::DOUBLE ELSE (len(rb) + len(rf))::DOUBLE / (len(blocks) + len(bullets)) END AS share,
        len(rb) - len(list_distinct(list_transform(rb, lambda x: lower(regexp_replace(x, '^\\s+|\\s+$', '', 'g'))))) AS duplicate_blocks,
        len(list_intersect({_GRAMS('rb')}, {_GRAMS('rf')})) AS collisions FROM f1 LEFT JOIN lp ON lp.handle = f1.handle""",
    "f3": f"""SELECT *, len(regexp_extract_all({_FOLD('content')}, '(?i)\\b\\d+[\\s-]*({rules.UNITS})\\b')) + len(regexp_extract_all(content, '(?i)({rules.MATERIALS})'))
        + len(regexp_extract_all({_FOLD('content')}, '\\b[A-Z]{{2,}}\\b')) AS tech,
        CASE WHEN share >= 0.8 THEN 28 WHEN share >= 0.6 THEN 22 WHEN share >= 0.4 THEN 15 WHEN share >= 0.2 THEN 8 WHEN share >= 0.01 THEN 3 ELSE 0 END AS base,
        len(list_filter(list_filter(regexp_split_to_array(lower(product_name), '\\s+'), lambda w: length(w) > 2), lambda w: contains(lower(content), w))) > 0 AS named FROM f2""",
    "f4": """SELECT handle, duplicate_blocks::BIGINT AS duplicate_blocks, near_pairs::BIGINT AS near_pairs, collisions::BIGINT AS collisions,
        (CASE WHEN length(trim(ld)) > 50 THEN least(30, base + 5) ELSE base END)::BIGINT AS signal,
        (CASE WHEN product_name <> '' THEN 4 ELSE 0 END + CASE WHEN brand <> '' THEN 3 ELSE 0 END + CASE WHEN len(rb) >= 1 THEN 5 ELSE 0 END + CASE WHEN len(rf) >= 3 THEN 5 WHEN len(rf) = 2 THEN 3 WHEN len(rf) = 1 THEN 1 ELSE 0 END
          + CASE WHEN len(specs) >= 2 THEN 4 WHEN len(specs) = 1 THEN 2 ELSE 0 END + CASE WHEN materials <> '' THEN 2 ELSE 0 END + CASE WHEN care <> '' THEN 2 ELSE 0 END)::BIGINT AS completeness,
        (CASE WHEN named THEN 7 ELSE 0 END + CASE WHEN tech >= 3 THEN 6 WHEN tech >= 1 THEN 4 ELSE 0 END + least(6, 2 * len(list_filter(specs, lambda v: regexp_matches(v, '\\d') OR length(trim(v)) > 3)))
          + CASE WHEN materials = '' THEN 0 WHEN regexp_matches(materials, '\\d+\\s*%') THEN 6 ELSE 3 END)::BIGINT AS specificity,
        (greatest(0, 8 - duplicate_blocks * 2) + greatest(0, 6 - near_pairs * 2) + greatest(0, 6 - collisions * 3))::BIGINT AS uniqueness FROM f3""",
}
_ESC = lambda c: f"replace(replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"
_CUT = lambda c, n: f"CASE WHEN length({c}) > {n} THEN left({c}, {n - 3}) || '...' ELSE {c} END"

ORACLES = {
    "output_quality": with_tables(f"SELECT handle, {', '.join(_AXES)} FROM o4", _OUT),
    "quality_rollup": with_tables("SELECT count(*) AS outputs, " + ", ".join(f"{r(f'avg({c})', 6)} AS {a}" for c, a in [("total", "avg_total"), ("total", "avg_pct")] + [(x, f"avg_{x}") for x in _AXES[:-1]]) + " FROM o4", _OUT),
    "fact_quality": with_tables(f"SELECT {', '.join(c for c in ['handle', *_FACT] if c != 'total')}, signal + completeness + specificity + uniqueness AS total FROM f4", _FACTS | _PAIRS("bullet_lines", "handle")),
    "near_dup_pairs": with_tables("SELECT doc_id, pairs FROM lp", {"all_lines": "SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents"} | _PAIRS("all_lines", "doc_id")),
    "ngram_overlap": with_tables(f"SELECT handle, len(list_intersect({_GRAMS('blocks')}, {_GRAMS('bullets')}))::BIGINT AS shared FROM facts WHERE shared > 0"),
    "fallback_drafts": with_tables(f"""SELECT handle, concat_ws(chr(10), CASE WHEN len(blocks) > 0 THEN '<p>' || {_ESC(_CUT('blocks[1]', 500))} || '</p>' END,
        CASE WHEN len(bullets) > 0 THEN '<h3>Features</h3>' || chr(10) || '<ul>' || chr(10) || array_to_string(list_transform(bullets[1:6], lambda b: '<li>' || {_ESC(_CUT('b', 100))} || '</li>'), chr(10)) || chr(10) || '</ul>' END,
        CASE WHEN len(specs) > 0 THEN '<h3>Specifications</h3>' || chr(10) || '<table>' || chr(10) || '<tr><td>weight</td><td>' || {_ESC('specs[1]')} || '</td></tr>'
          || CASE WHEN len(specs) > 1 THEN chr(10) || '<tr><td>fit</td><td>' || specs[2] || '</td></tr>' ELSE '' END || chr(10) || '</table>' END) AS html FROM facts"""),
    "fallback_drafts_whole": with_tables(f"""SELECT handle, concat_ws(chr(10), CASE WHEN len(blocks) > 0 THEN '<p>' || {_ESC('blocks[1]')} || '</p>' END,
        CASE WHEN len(bullets) > 0 THEN '<h3>Features</h3>' || chr(10) || '<ul>' || chr(10) || array_to_string(list_transform(bullets, lambda b: '<li>' || {_ESC('b')} || '</li>'), chr(10)) || chr(10) || '</ul>' END,
        CASE WHEN len(specs) > 0 THEN '<h3>Specifications</h3>' || chr(10) || '<table>' || chr(10) || '<tr><td>weight</td><td>' || {_ESC('specs[1]')} || '</td></tr>'
          || CASE WHEN len(specs) > 1 THEN chr(10) || '<tr><td>fit</td><td>' || specs[2] || '</td></tr>' ELSE '' END || chr(10) || '</table>' END) AS html FROM facts"""),
    "boilerplate_lines": f"SELECT lang, count(*) AS lines, count(*) FILTER ({_ISBOIL('line')}) AS boilerplate FROM (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1",
    "output_confidence": with_tables("""SELECT handle, greatest(0, least(100, 50 + CASE WHEN length(body_html) > 200 THEN 15 WHEN length(body_html) > 100 THEN 10 WHEN length(body_html) > 0 THEN 5 ELSE 0 END
        + least(doc_id % 8 * 3, 15) + least(doc_id % 5 * 2, 10) - CASE WHEN doc_id % 6 = 0 THEN 12 WHEN doc_id % 4 = 0 THEN 2 ELSE 0 END
        + 5 * ((ld <> '')::INT + (len(bullets) > 0)::INT + (len(specs) > 0)::INT)))::BIGINT AS confidence FROM outputs"""),
}
