"""DuckDB SQL for the queries that SQL can express over whole tables in reasonable time.

The others (near duplicates, runs of lines, HTML, fingerprints, tokens, packing, the language
model) are tested against brute force in plain Python.
"""

from __future__ import annotations

from playlens.llm import codes, negatives
from playlens.llm.mixing import CAP, CLASSES, DRAW_DIGITS, RANK_BITS, SHARE, WEIGHTS
from playlens.llm.quality import RULES
from playlens.llm.urls import REFERENCES, RULES as URL_RULES

WORD = r"[^\x20\x09-\x0D]+"

QUALITY = rf"""
WITH base AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '{WORD}') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda line: regexp_matches(line, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
grams AS (
  SELECT row, unnest(list_transform(range(1, len(words) - 3), lambda i: words[i:i + 4])) AS gram, unnest(range(1, len(words) - 3)) AS i
  FROM base WHERE len(words) > 4),
windows AS (SELECT row, unnest(list(i)) AS i FROM grams GROUP BY row, gram HAVING count(*) > 1),
covered AS (SELECT row, count(DISTINCT place) AS n FROM (SELECT row, unnest(range(i, i + 5)) AS place FROM windows) GROUP BY row),
measured AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words,
    CAST(len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) AS BIGINT) AS n_stutters
  FROM base LEFT JOIN covered USING (row)),
judged AS (
  SELECT *, CAST({" + ".join(f"CASE WHEN {r.fails} THEN {r.mask} ELSE 0 END" for r in RULES)} AS BIGINT) AS failed FROM measured)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, failed = 0 AS kept FROM judged"""

_LIMIT = f"{CAP} * source_size"
_RATIO = [f"least({w} * level{len(CLASSES) - 1}, {CAP})" for _, w in CLASSES]


def _mixing() -> str:
    weight = "[" + ", ".join(map(str, WEIGHTS)) + "]"
    classes = "0"
    for i, (least, _) in enumerate(CLASSES[1:], 1):
        classes = f"CASE WHEN size >= {least} THEN {i} ELSE {classes} END"
    sums = ", ".join(f"CAST(sum(CASE WHEN class = {i} THEN size ELSE 0 END) AS BIGINT) AS s{i}" for i in range(len(CLASSES)))
    # A class is stopped when its share at the first level passes the cap; the second level is final.
    open0 = " + ".join(f"{w} * s{i}" for i, (_, w) in enumerate(CLASSES))
    full = " + ".join(f"CASE WHEN {w} * level0 > {CAP} THEN {CAP} * s{i} ELSE 0.0 END" for i, (_, w) in enumerate(CLASSES))
    rest = " + ".join(f"CASE WHEN {w} * level0 > {CAP} THEN 0.0 ELSE {w} * s{i} END" for i, (_, w) in enumerate(CLASSES))
    ratios = ", ".join(
        f"CASE WHEN {w} * level0 > {CAP} OR {w} * level1 > {CAP} THEN {CAP} ELSE least({w} * level1, {CAP}) END AS r{i}"
        for i, (_, w) in enumerate(CLASSES)
    )
    need = " + ".join(f"(r{i} - floor(r{i})) * s{i}" for i in range(len(CLASSES)))
    return f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, row_number() OVER () AS row, coalesce(md5(text), 'null') AS text_key,
    len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
    (CAST('0x' || substr(md5(concat_ws(':', doc_id, coalesce(md5(text), 'null'), '1')), 1, {DRAW_DIGITS}) AS BIGINT) + 0.5::DOUBLE)
      / {2.0 ** (4 * DRAW_DIGITS)!r}::DOUBLE AS draw
  FROM documents),
rows AS (SELECT *, {classes} AS class FROM sized),
sources AS (
  SELECT *, ({weight}::DOUBLE[])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS weight
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, {sums} FROM rows GROUP BY source)),
levels(turn, level) AS (
  SELECT 0, {SHARE}::DOUBLE * sum(source_size) / sum(weight) FROM sources
  UNION ALL SELECT turn + 1, (
    SELECT ({SHARE}::DOUBLE * sum(source_size) - coalesce(sum({_LIMIT}) FILTER (weight * level > {_LIMIT}), 0))
      / sum(weight) FILTER (NOT weight * level > {_LIMIT}) FROM sources)
  FROM levels WHERE turn < 20 AND level IS NOT NULL),
level AS (SELECT arg_max(level, turn) AS level FROM levels WHERE level IS NOT NULL),
goals AS (
  SELECT *, CASE WHEN weight * level > {_LIMIT} THEN CAST({_LIMIT} AS DOUBLE) ELSE least(weight * level, CAST({_LIMIT} AS DOUBLE)) END AS target
  FROM sources, level),
first_level AS (SELECT *, CASE WHEN {open0} > 0 THEN target / ({open0}) ELSE 0.0 END::DOUBLE AS level0 FROM goals),
second_level AS (SELECT *, CASE WHEN {rest} > 0 THEN (target - ({full})) / ({rest}) ELSE 0.0 END::DOUBLE AS level1 FROM first_level),
rated AS (SELECT source, source_size, target, s0, s1, {ratios} FROM second_level),
needed AS (SELECT *, {need} AS need FROM rated),
joined AS (
  SELECT r.doc_id, r.source, r.row, r.text_key, r.size, r.draw, n.source_size, n.target, n.need,
    floor([r0, r1][class + 1]) AS certain, [r0, r1][class + 1] - floor([r0, r1][class + 1]) AS chance
  FROM rows r JOIN needed n ON r.source IS NOT DISTINCT FROM n.source),
odds AS (SELECT *, CASE WHEN chance > 0 THEN draw / (1 - draw) * (1 - chance) / chance END AS odds FROM joined),
ranked AS (SELECT *, CAST(least(floor(odds / (1 + odds) * {2.0 ** RANK_BITS!r}::DOUBLE), {2 ** RANK_BITS - 1}) AS BIGINT) AS rank FROM odds),
running AS (
  SELECT source, need, rank, sum(n) OVER (PARTITION BY source ORDER BY rank) AS after, sum(n) OVER (PARTITION BY source ORDER BY rank) - n AS before,
    lead(rank) OVER (PARTITION BY source ORDER BY rank) IS NULL AS last
  FROM (SELECT source, need, rank, sum(size) AS n FROM ranked WHERE chance > 0 AND size > 0 GROUP BY ALL)),
cuts AS (SELECT source, rank AS cut, before FROM running WHERE before < need AND (after >= need OR last)),
placed AS (
  SELECT r.*, c.cut, c.before, coalesce(r.rank = c.cut, false) AS at_cut,
    coalesce(sum(r.size) OVER (PARTITION BY r.source, coalesce(r.rank = c.cut, false) ORDER BY r.doc_id, r.text_key, r.row
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM (SELECT * REPLACE (CASE WHEN chance > 0 AND size > 0 THEN rank END AS rank) FROM ranked) r
    LEFT JOIN cuts c ON r.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(size * (certain + CASE WHEN at_cut THEN CAST(size <= 2 * (need - before - ahead) AS INT) WHEN rank < cut THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM placed"""


def _urls() -> tuple[str, str]:
    def fits(rule) -> str:
        return f"((host = '{rule.host}' OR ends_with(host, '.{rule.host}')) AND starts_with(path, '{rule.path}'))"

    order = sorted(URL_RULES, key=lambda r: (-len(r.text), r.verdict != "allow"))
    rule = " ".join(f"WHEN {fits(r)} THEN '{r.text}'" for r in order)
    verdict = " ".join(f"WHEN '{r.text}' THEN '{r.verdict}'" for r in order)

    def parts(url: str) -> str:
        upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
        return (
            rf"translate(regexp_extract(coalesce({url}, ''), '(?s)^.*?://([^/?#]*)', 1), '{upper}', '{lower}') AS host, "
            rf"regexp_extract(coalesce({url}, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, "
            rf"regexp_extract(coalesce({url}, ''), '(?s)^[^#]*?(\?[^#]*)', 1) AS query"
        )

    def links() -> str:
        """Links that pages declare, as full addresses."""
        attribute = lambda name, of: (
            f"list_aggregate(regexp_extract_all({of}, '(?is)(?:^|[^\\w-]){name}\\s*=\\s*(?:\"([^\"]*)\"|''([^'']*)''|([^\\s\"''>]+))', 0)[1:1], 'string_agg', '')"
        )
        value = lambda name, of: (
            f"regexp_replace(regexp_replace(coalesce({attribute(name, of)}, ''), '(?is)^.?{name}\\s*=\\s*', ''), '^([\"''])(.*)[\"'']$', '\\2', 's')"
        )
        code = (
            "CASE WHEN regexp_matches(ref, '^#[xX]') THEN CAST('0x' || ref[3:] AS BIGINT) WHEN starts_with(ref, '#') THEN CAST(ref[2:] AS BIGINT) "
            "ELSE CASE ref " + " ".join(f"WHEN '{n}' THEN {c}" for n, c in REFERENCES.items()) + " END END"
        )
        dots = lambda p: (
            f"CASE WHEN regexp_matches({p}, '/\\.\\.?(/|$)') THEN list_reduce(string_split({p}, '/')[2:], lambda done, x: "
            "CASE WHEN x = '.' THEN done WHEN x = '..' THEN regexp_replace(done, '/[^/]*$', '') ELSE done || '/' || x END, '') || "
            f"CASE WHEN regexp_matches({p}, '/\\.\\.?$') THEN '/' ELSE '' END ELSE {p} END"
        )
        return rf"""
cleaned AS (
  SELECT url, regexp_replace(html, '(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<textarea\b.*?(?:</textarea\s*>|\z)|<title\b.*?(?:</title\s*>|\z)|<noscript\b.*?(?:</noscript\s*>|\z)|<template\b.*?(?:</template\s*>|\z)', ' ', 'g') || '>' AS html
  FROM pages WHERE url IS NOT NULL AND html IS NOT NULL),
elements AS (SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS element FROM cleaned),
raw AS (
  SELECT row_number() OVER () AS n, url, CASE
    WHEN regexp_matches(element, '(?i)^<link') AND list_contains(regexp_split_to_array(lower(trim({value("rel", "element")})), '\s+'), 'canonical') THEN {value("href", "element")}
    WHEN regexp_matches(element, '(?i)^<meta') AND lower(trim({value("http-equiv", "element")})) = 'refresh' THEN {value("content", "element")} END AS link,
    regexp_matches(element, '(?i)^<meta') AS refresh
  FROM elements),
pieces AS (SELECT n, url, refresh, unnest(string_split(link, '&')) AS part, generate_subscripts(string_split(link, '&'), 1) AS i FROM raw WHERE link IS NOT NULL),
named AS (SELECT *, CASE WHEN i > 1 THEN regexp_extract(part, '^(#[0-9]{{1,7}}|#[xX][0-9a-fA-F]{{1,6}}|[A-Za-z]+);', 1) ELSE '' END AS ref FROM pieces),
coded AS (SELECT *, CASE WHEN ref <> '' THEN {code} END AS code FROM named),
decoded AS (
  SELECT url, refresh, string_agg(CASE WHEN i = 1 THEN part
    WHEN code BETWEEN 1 AND 1114111 AND code NOT BETWEEN 55296 AND 57343 THEN chr(CAST(code AS INT)) || part[length(ref) + 2:] ELSE '&' || part END, '' ORDER BY i) AS link
  FROM coded GROUP BY n, url, refresh),
found AS (
  SELECT url, regexp_replace(CASE WHEN refresh THEN
    regexp_replace(regexp_extract(link, '(?is)^[\s\d.]*[;,]?\s*url\s*=\s*("[^"]*|''[^'']*|[^"''].*)', 1), '^["'']', '') ELSE link END, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') AS link
  FROM decoded),
split AS (
  SELECT url, link, regexp_extract(url, '(?s)^(.*?:)//', 1) AS scheme, {parts("url")}, regexp_extract(link, '(?s)^([^?#]*)', 1) AS target,
    regexp_extract(link, '(?s)^[^?#]*(.*)$', 1) AS rest FROM found WHERE link <> ''),
placed AS (SELECT *, '/' || ltrim(regexp_replace(path, '[^/]*$', '') || target, '/') AS full_path, scheme || '//' || host AS site FROM split),
links AS (
  SELECT url, CASE WHEN regexp_matches(link, '^[a-zA-Z][a-zA-Z0-9+.-]*://') THEN link WHEN regexp_matches(link, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN NULL
    WHEN starts_with(link, '//') THEN scheme || link WHEN target = '' THEN site || path || rest
    WHEN starts_with(link, '/') THEN site || {dots("target")} || rest ELSE site || {dots("full_path")} || rest END AS target
  FROM placed)"""

    shared = """
firsts AS (SELECT page_id // 5 AS five, arg_min(url, page_id) AS target FROM pages GROUP BY ALL),
links AS (SELECT url, target FROM pages JOIN firsts ON page_id // 5 = five)"""

    def judged(links: str) -> str:
        return rf"""
WITH RECURSIVE {links},
addresses AS (SELECT url AS address FROM links UNION SELECT target FROM links WHERE target IS NOT NULL UNION SELECT url FROM pages),
known AS (
  SELECT address, host, path, host || regexp_replace(path, '/+$', '') || query AS node, CASE {rule} END AS rule
  FROM (SELECT address, {parts("address")} FROM addresses)),
judged AS (SELECT *, CASE rule {verdict} END AS own FROM known),
edges AS (
  SELECT a.node AS a, b.node AS b FROM links JOIN known a ON a.address = url JOIN known b ON b.address = target
  WHERE a.node <> b.node AND a.node <> '' AND b.node <> ''),
ends AS (SELECT ends.address FROM links JOIN known a ON a.address = url JOIN known b ON b.address = target,
  LATERAL (SELECT unnest([url, target]) AS address) ends WHERE a.node <> b.node AND a.node <> '' AND b.node <> ''),
ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(node, other) AS (SELECT a, a FROM ways UNION SELECT r.node, w.b FROM reach r JOIN ways w ON r.other = w.a),
blocked AS (
  SELECT r.node FROM reach r JOIN judged j ON j.node = r.other WHERE j.address IN (FROM ends)
  GROUP BY r.node HAVING bool_or(own = 'block') AND NOT coalesce(bool_or(own = 'allow'), false))
SELECT p.page_id, j.host, j.path, j.rule, coalesce(j.own, CASE WHEN j.node IN (FROM blocked) THEN 'block' ELSE 'allow' END) AS verdict
FROM pages p JOIN judged j ON j.address IS NOT DISTINCT FROM p.url"""

    return judged(links()), judged(shared)


#: Rows whose vector is whole; all vectors of the given tables have one length.
_WHOLE = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"


def _codes() -> str:
    """Lloyd's rounds over all distances, written out."""
    def assigned(r: int) -> str:
        return f"""assigned{r} AS MATERIALIZED (
  SELECT row, part, min(struct_pack(d := squares - 2 * list_dot_product(v, e) + list_dot_product(e, e), entry := entry)) AS best
  FROM parts JOIN book{r} USING (part) GROUP BY row, part)"""

    def moved(r: int) -> str:
        return f"""sums{r} AS (
  SELECT part, best.entry AS entry, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM assigned{r} JOIN parts USING (row, part)),
means{r} AS (SELECT part, entry, list(x ORDER BY i) AS e FROM (
  SELECT part, entry, i, floor(sum(x) / count(*)) AS x FROM sums{r} GROUP BY ALL) GROUP BY ALL),
book{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.e, b.e) AS e FROM book{r} b LEFT JOIN means{r} m USING (part, entry))"""

    rounds = ",\n".join(f"{assigned(r)},\n{moved(r)}" for r in range(codes.ROUNDS))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS row, vec_id, label, v FROM (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * {codes.SCALE})) AS v FROM embeddings WHERE {_WHOLE})),
cut AS (SELECT row, p AS part, list_slice(v, CAST(p * len(v) // {codes.PARTS} + 1 AS BIGINT), CAST((p + 1) * len(v) // {codes.PARTS} AS BIGINT)) AS v
  FROM kept, range({codes.PARTS}) r(p)),
parts AS MATERIALIZED (SELECT *, list_dot_product(v, v) AS squares FROM cut),
book0 AS MATERIALIZED (SELECT part, row AS entry, v AS e FROM parts WHERE row < {codes.ENTRIES}),
{rounds},
{assigned(codes.ROUNDS)},
coded AS (
  SELECT row, string_agg(printf('%02x', CAST(best.entry AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM assigned{codes.ROUNDS} GROUP BY row),
checksum AS (SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, i)) AS codebooks_sha256 FROM (
  SELECT part, entry, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM book{codes.ROUNDS}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (row), checksum"""


NEGATIVES = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * {negatives.SCALE})) AS v
  FROM embeddings WHERE label IS NOT NULL AND {_WHOLE}),
scored AS MATERIALIZED (
  SELECT a.row AS anchor, a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
  FROM kept a JOIN kept r ON a.row <> r.row WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST) AS n FROM scored WHERE same QUALIFY n <= {negatives.POSITIVES})
SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
  CAST(row_number() OVER (PARTITION BY p.anchor, p.n ORDER BY s.score DESC, s.vec_id NULLS LAST) AS INTEGER) AS rank
FROM positives p JOIN scored s ON p.anchor = s.anchor AND NOT s.same
  AND {negatives.LOW} * p.score <= 100 * s.score AND 100 * s.score <= {negatives.HIGH} * p.score
QUALIFY rank <= {negatives.NEGATIVES}"""


def oracles() -> dict[str, str]:
    declared, shared = _urls()
    return {
        "op1_quality_rules": QUALITY, "op6_pareto_mixing": _mixing(), "op10_url_filters": declared, "url_filters_shared_addresses": shared,
        "op12_vector_codes": _codes(), "op13_hard_negatives": NEGATIVES,
    }
