"""The SQL each registered query is checked against, written for DuckDB."""

from __future__ import annotations

from checks.derive import ALL_FIELDS

# Written out here, so that a fault in the library's own lists and patterns shows.
STOP_LIST = """'a', 'an', 'and', 'are', 'as', 'at', 'be', 'but', 'by', 'for', 'if', 'in', 'into', 'is', 'it', 'no', 'not', 'of', 'on',
    'or', 'such', 'that', 'the', 'their', 'then', 'there', 'these', 'they', 'this', 'to', 'was', 'will', 'with'"""
URL_PATTERN = r"(?:https?|ftp)://[^\s<>\"]*[\p{L}\p{N}/]|www\.[^\s<>\"]*[\p{L}\p{N}/]"
EMAIL_PATTERN = r"[a-z0-9._%+\-]+@[a-z0-9\-]+(?:\.[a-z0-9\-]+)+"
WORD = r"[\p{L}\p{N}]+"
URL_EMAIL_WORD = f"{URL_PATTERN}|{EMAIL_PATTERN}|{WORD}"

# --- shared table expressions ---------------------------------------------------------------

TRAIN = """train AS (
  SELECT 'train' AS corpus, d.doc_id AS id, split_part(d.text, chr(10), 1) AS title, d.text AS body,
         '' AS code, '' AS links,
         d.lang || ' ' || d.source
           || CASE l.quality WHEN 1 THEN ' good' WHEN 0 THEN ' bad' ELSE '' END
           || CASE l.toxic WHEN 1 THEN ' toxic' WHEN 0 THEN ' clean' ELSE '' END AS tags
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

TEST = """test AS (
  SELECT 'test' AS corpus, item_id AS id, split_part(text, chr(10), 1) AS title, text AS body,
         '' AS code, '' AS links, '' AS tags
  FROM benchmark)"""

CHATS = """chats AS (
  SELECT 'chat' AS corpus, conv_id * 1000 + turn AS id, split_part(text, chr(10), 1) AS title, text AS body,
         '' AS code, '' AS links, role AS tags
  FROM conversations)"""

BOTH = f"{TRAIN}, {TEST}, both_ AS (SELECT * FROM train UNION ALL SELECT * FROM test)"


def analysed(text: str, pattern: str = WORD) -> str:
    return (f"list_filter(regexp_extract_all(lower({text}), '{pattern}'), "
            f"lambda t: t NOT IN ({STOP_LIST}))")


def indexed(source: str = "both_", text: str = "body", pattern: str = WORD, p: str = "") -> str:
    """docs, postings, statistics of a table; ``p`` prefixes the names."""
    return f"""{p}doc AS (SELECT corpus, id, tags, {analysed(text, pattern)} AS toks FROM {source}),
{p}len AS (SELECT corpus, id, tags, len(toks) AS doc_len FROM {p}doc),
{p}tok AS (SELECT corpus, id, unnest(toks) AS term FROM {p}doc),
{p}post AS (SELECT corpus, id, term, count(*) AS tf FROM {p}tok GROUP BY ALL),
{p}stats AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS ttf FROM {p}post GROUP BY term),
{p}n AS (SELECT count(*) AS n_docs, sum(doc_len)::BIGINT AS sum_ttf,
        sum(doc_len)::DOUBLE / count(*) AS avgdl FROM {p}len)"""


def selected(source: str = "test", text: str = "body", max_tokens: int | None = None, min_tf: int = 1,
             limit: str = "s.df >= 1", max_terms: int = 25, boost: str = "1.0",
             limits_from: str | None = None, p: str = "") -> str:
    """qtf and qt (query_id, term, tf, df, idf, micro, rank, boost)."""
    join_limits = f"JOIN {limits_from} lim ON lim.term = q.term" if limits_from else ""
    stats = f"LEFT JOIN {p}stats s ON s.term = q.term" if limits_from else f"JOIN {p}stats s ON s.term = q.term"
    return f"""{p}qtf AS (SELECT query_id, term, count(*) AS tf FROM (
  SELECT id AS query_id, unnest(({analysed(text)}){'' if max_tokens is None else f'[1:{max_tokens}]'}) AS term FROM {source}) GROUP BY ALL),
{p}qs AS (SELECT q.query_id, q.term, q.tf, coalesce(s.df, 0) AS df,
    ln(1.0::DOUBLE + (n_docs - coalesce(s.df, 0) + 0.5::DOUBLE) / (coalesce(s.df, 0) + 0.5::DOUBLE)) AS idf
  FROM {p}qtf q {stats} {join_limits}, {p}n WHERE q.tf >= {min_tf} AND {limit}),
{p}qr AS (SELECT *, round(tf * idf * 1000000)::BIGINT AS micro FROM {p}qs),
{p}qrank AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY micro DESC, term) AS rank FROM {p}qr),
{p}qb AS (SELECT * FROM {p}qrank WHERE rank <= {max_terms}),
{p}qt AS (SELECT *, {boost} AS boost FROM {p}qb)"""


BM25_WEIGHT = "q.boost * q.idf * (1.2::DOUBLE + 1.0)"
BM25_IMPACT = "d.tf / (d.tf + 1.2::DOUBLE * ((1.0::DOUBLE - 0.75) + 0.75::DOUBLE * l.doc_len / n.avgdl))"


def scored(weight: str = BM25_WEIGHT, impact: str = BM25_IMPACT, where: str = "true", p: str = "") -> str:
    """sc (query_id, id, micro)."""
    return f"""{p}sc AS (SELECT q.query_id, d.id, sum(round({weight} * ({impact}) * 1000000)::BIGINT)::BIGINT AS micro
  FROM {p}qt q JOIN {p}post d ON d.term = q.term
  JOIN {p}len l ON l.corpus = d.corpus AND l.id = d.id, {p}n n
  WHERE {where} GROUP BY q.query_id, d.id)"""


def best(k: int, where: str = "true", p: str = "") -> str:
    """top (query_id, rank, id, score)."""
    return f"""{p}top AS (SELECT query_id, rank::INTEGER AS rank, id, micro::DOUBLE / 1000000 AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY micro DESC, id) AS rank FROM {p}sc WHERE {where})
  WHERE rank <= {k})"""


TAGGED = """nb AS (SELECT t.query_id, t.rank, t.id, t.score, l.tags
  FROM top t JOIN len l ON l.id = t.id AND l.corpus = 'train')"""


def neighbors(k: int = 5, text: str = "body", **kw) -> str:
    """From the base tables to nb (query_id, rank, id, score, tags)."""
    return ",\n".join([BOTH, indexed(text=text), selected(text=text, **kw),
                       scored(where="d.corpus = 'train'"), best(k), TAGGED])


SPLIT = f"""{TRAIN}, parts AS (SELECT * REPLACE (CASE WHEN id % 10 = 0 THEN 'test' ELSE 'train' END AS corpus) FROM train),
asked AS (SELECT * FROM parts WHERE corpus = 'test'), kept AS (SELECT * FROM parts WHERE corpus = 'train')"""


def held_out(k: int) -> str:
    return ",\n".join([SPLIT, indexed("parts"), selected("asked"), scored(where="d.corpus = 'train'"),
                       best(k), TAGGED])


def parsed(tags: str) -> str:
    """The tag rules: trailing blanks off, '' gives one empty tag, blanks give none."""
    cut = f"regexp_replace({tags}, '\\s+$', '')"
    return (f"CASE WHEN {tags} = '' THEN [''] WHEN {cut} = '' THEN []::VARCHAR[] "
            f"ELSE list_distinct(regexp_split_to_array({cut}, '\\s+')) END")


def parsed_in_order(tags: str) -> str:
    cut = f"regexp_replace({tags}, '\\s+$', '')"
    parts = f"regexp_split_to_array({cut}, '\\s+')"
    return (f"CASE WHEN {tags} = '' THEN [''] WHEN {cut} = '' THEN []::VARCHAR[] ELSE "
            f"list_filter({parts}, lambda x, i: list_position({parts}, x) = i) END")


def candidates(k: int) -> str:
    return (f"cand AS (SELECT DISTINCT query_id AS id, unnest({parsed('tags')}) AS tag FROM nb WHERE rank <= {k})")


def union_tags(k: int, queries: str) -> str:
    return f"""{candidates(k)},
pred AS (SELECT q.id, coalesce(string_agg(c.tag, ' ' ORDER BY c.tag), '') AS tags
  FROM {queries} q LEFT JOIN cand c ON c.id = q.id GROUP BY q.id)"""


ROW_SCORES = f"""truth AS (SELECT id, {parsed('tags')} AS expected FROM parts),
rowsc AS (SELECT p.id, {parsed('p.tags')} AS predicted, t.expected FROM pred p LEFT JOIN truth t ON t.id = p.id),
prs AS (SELECT id, len(list_intersect(predicted, expected)) AS tp, len(predicted) AS n_predicted,
    len(expected) AS n_expected,
    CASE WHEN expected IS NULL THEN NULL WHEN len(predicted) = 0 THEN 0
      ELSE len(list_intersect(predicted, expected))::DOUBLE / len(predicted) END AS "precision",
    CASE WHEN expected IS NULL THEN NULL WHEN len(expected) = 0 THEN 0
      ELSE len(list_intersect(predicted, expected))::DOUBLE / len(expected) END AS recall,
    expected IS NULL AS missing FROM rowsc)"""

TAG_SCORES = f"""{TRAIN}, pairs AS (SELECT id, unnest({parsed('tags')}) AS tag FROM train),
scores AS (SELECT id, tag, ((id * 7 + length(tag) * 13) % 20 - 14)::DOUBLE / 8 AS score FROM pairs)"""

WORDS = f"""wb AS (SELECT id, term, count(*) AS n FROM (
  SELECT id, unnest({analysed('body')}) AS term FROM asked
  UNION ALL SELECT id, unnest({analysed('title')}) FROM asked) GROUP BY ALL)"""

# Scripts of the pages hold a quoted end tag, which is text.
PAGE_TEXT = r"""regexp_replace(regexp_replace(html, '(<script[^>]*>[^<]*)</p>', '\1' || chr(1), 'g'),
    '<!--.*?-->|<[^>]*>', '', 'gs')"""


def decoded(text: str) -> str:
    for name, char in (("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"),
                       ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        text = f"replace({text}, '{name}', '{char}')"
    return text


LINKS = "array_to_string(regexp_extract_all(html, '(?i)<a\\b[^>]*>([^<]*)</a>', 1), chr(10))"


def bag(fields: list[str], size: int) -> str:
    parts, heads = [], []
    for field in fields:
        i = ["title", "body", "tags"].index(field)
        words = parsed("lower(tags)") if field == "tags" else analysed(field)
        heads.append(f"""c{i} AS (SELECT id, term, count(*) AS n FROM (SELECT id, unnest({words}) AS term FROM train) GROUP BY ALL),
v{i} AS (SELECT term FROM c{i} GROUP BY term ORDER BY sum(n) DESC, term LIMIT {size})""")
        parts.append(f"SELECT id, '{i}_' || term AS feature, n FROM c{i} JOIN v{i} USING (term)")
    return f"WITH {TRAIN}, " + ", ".join(heads) + ", bow AS (" + " UNION ALL ".join(parts) + ") "


# Both searches of ML-kNN: train questions among themselves, asked ones among the train ones.
ML_KNN = ",\n".join([
    SPLIT, indexed("parts"), selected("kept"), scored(where="d.corpus = 'train' AND d.id <> q.query_id"), best(10),
    "fit_near AS (SELECT * FROM top)",
    selected("asked").replace("qtf", "aqtf").replace("qs AS", "aqs AS").replace("FROM qs", "FROM aqs")
    .replace("qrank", "aqrank").replace("qr AS", "aqr AS").replace("FROM qr)", "FROM aqr)")
    .replace("qb", "aqb").replace("qt AS", "aqt AS"),
    scored(where="d.corpus = 'train'").replace("FROM qt q", "FROM aqt q").replace("sc AS", "asc_ AS"),
    best(10).replace("FROM sc", "FROM asc_").replace("top AS", "near AS"),
]) + f""",
pairs AS (SELECT id, unnest({parsed('lower(tags)')}) AS label FROM kept),
m AS (SELECT count(*)::DOUBLE AS n FROM kept),
sizes AS (SELECT label, count(*)::DOUBLE AS nl FROM pairs GROUP BY label),
fit_c AS (SELECT t.query_id AS id, p.label, count(*) AS j FROM fit_near t JOIN pairs p ON p.id = t.id GROUP BY ALL),
grid AS (SELECT k.id, s.label, coalesce(c.j, 0) AS j, (o.id IS NOT NULL) AS own
  FROM kept k CROSS JOIN sizes s LEFT JOIN fit_c c ON c.id = k.id AND c.label = s.label
  LEFT JOIN pairs o ON o.id = k.id AND o.label = s.label),
cells AS (SELECT label, j, count(*) FILTER (own) AS a, count(*) FILTER (NOT own) AS b FROM grid GROUP BY ALL),
near_c AS (SELECT t.query_id AS id, p.label, count(*) AS j FROM near t JOIN pairs p ON p.id = t.id GROUP BY ALL),
judge AS (SELECT a.id, s.label, s.nl, coalesce(c.j, 0) AS j
  FROM asked a CROSS JOIN sizes s LEFT JOIN near_c c ON c.id = a.id AND c.label = s.label),
prob AS (SELECT g.id, g.label,
    (1 + g.nl) / (2 + n) * (1 + coalesce(c.a, 0)) / (11 + g.nl) AS yes,
    (1 - (1 + g.nl) / (2 + n)) * (1 + coalesce(c.b, 0)) / (11 + n - g.nl) AS no
  FROM judge g LEFT JOIN cells c ON c.label = g.label AND c.j = g.j, m)"""

# ML-kNN with ten folds by id: f is the fold held out.
CROSS_ML_KNN = ",\n".join([TRAIN, indexed("train"), selected("train"), scored(where="d.id <> q.query_id")]) + f""",
folds AS (SELECT unnest(range(10)) AS f),
rows_ AS (SELECT id, id % 10 AS own FROM train),
top AS (SELECT f, query_id, id FROM (SELECT f, query_id, id, row_number() OVER (PARTITION BY f, query_id ORDER BY micro DESC, id) AS r
  FROM sc, folds WHERE id % 10 <> f) WHERE r <= 10),
pairs AS (SELECT id, id % 10 AS own, unnest({parsed('lower(tags)')}) AS label FROM train),
m AS (SELECT f, count(*) FILTER (own <> f)::DOUBLE AS n, count(*) FILTER (own = f) AS n_rows FROM rows_, folds GROUP BY f),
sizes AS (SELECT f, label, count(*)::DOUBLE AS nl FROM pairs, folds WHERE own <> f GROUP BY ALL),
c AS (SELECT t.f, t.query_id AS id, p.label, count(*) AS j FROM top t JOIN pairs p ON p.id = t.id GROUP BY ALL),
grid AS (SELECT s.f, k.id, k.own = s.f AS held, s.label, s.nl, coalesce(c.j, 0) AS j, o.id IS NOT NULL AS has
  FROM rows_ k CROSS JOIN sizes s LEFT JOIN c ON c.f = s.f AND c.id = k.id AND c.label = s.label
  LEFT JOIN pairs o ON o.id = k.id AND o.label = s.label),
cells AS (SELECT f, label, j, count(*) FILTER (has) AS a, count(*) FILTER (NOT has) AS b FROM grid WHERE NOT held GROUP BY ALL),
prob AS (SELECT g.f, g.id, g.label,
    (1 + g.nl) / (2 + n) * (1 + coalesce(c.a, 0)) / (11 + g.nl) AS yes,
    (1 - (1 + g.nl) / (2 + n)) * (1 + coalesce(c.b, 0)) / (11 + n - g.nl) AS no
  FROM grid g LEFT JOIN cells c ON c.f = g.f AND c.label = g.label AND c.j = g.j JOIN m ON m.f = g.f WHERE g.held),
said AS (SELECT f, id, label FROM prob WHERE yes / (yes + no) > 0.5),
met AS (SELECT coalesce(s.f, p.own) AS f, coalesce(s.id, p.id) AS id, coalesce(s.label, p.label) AS label,
    (s.id IS NOT NULL AND p.id IS NOT NULL)::BIGINT AS tp, (s.id IS NULL OR p.id IS NULL)::BIGINT AS wrong
  FROM said s FULL JOIN pairs p ON p.id = s.id AND p.label = s.label),
by_label AS (SELECT f, label, sum(tp) AS tp, sum(wrong) AS wrong FROM met GROUP BY ALL),
sums AS (SELECT f, sum(tp) AS tp, sum(wrong) AS wrong, sum(2 * tp / (2 * tp + wrong)::DOUBLE) AS f1 FROM by_label GROUP BY f),
bad AS (SELECT f, count(*) AS bad FROM (SELECT f, id FROM met GROUP BY f, id HAVING sum(wrong) > 0) GROUP BY f),
k AS (SELECT count(DISTINCT label) AS k FROM pairs)"""

# --- Porter's algorithm, a step per table expression --------------------------------------------

def shape(word: str) -> str:
    """0 for a vowel, 1 for a consonant; y is a vowel after a consonant."""
    y = f"regexp_replace(regexp_replace(replace({word}, 'v', 'b'), '^y', 'j'), '([^aeiouyY])y', '\\1Y', 'g')"
    return f"regexp_replace(regexp_replace(replace({y}, 'y', 'j'), '[aeiouY]', '0', 'g'), '[^0]', '1', 'g')"


def measure(word: str) -> str:
    return f"len(regexp_extract_all({shape(word)}, '0+1+'))"


def cvc(word: str) -> str:
    return f"(suffix({shape(word)}, '101') AND right({word}, 1) NOT IN ('w', 'x', 'y'))"


def swapped(table: dict[str, str], at_least: int, extra: str = "") -> str:
    """The word with its longest listed suffix replaced, if enough stays in front of it."""
    cases = []
    for end in sorted(table, key=len, reverse=True):
        stem = f"left(w, -{len(end)})"
        also = f" AND right({stem}, 1) IN ('s', 't')" if end == extra else ""
        cases.append(f"WHEN suffix(w, '{end}') THEN CASE WHEN {measure(stem)} >= {at_least}{also} THEN {stem} || '{table[end]}' ELSE w END")
    return "CASE " + " ".join(cases) + " ELSE w END"


# The suffixes of the published algorithm.
PORTER_2 = dict(p.split(":") for p in (
    "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate "
    "alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble").split())
PORTER_3 = dict(p.split(":") for p in "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:".split())
PORTER_4 = dict.fromkeys("al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split(), "")


def stems(source: str) -> str:
    """From ``source`` (word) to stemmed (word, w): the stem of each different word."""
    bare = "CASE WHEN suffix(w, 'ing') THEN left(w, -3) WHEN suffix(w, 'ed') THEN left(w, -2) END"
    steps = [
        "CASE WHEN suffix(w, 'sses') OR suffix(w, 'ies') THEN left(w, -2) WHEN suffix(w, 's') AND NOT suffix(w, 'ss') THEN left(w, -1) ELSE w END",
        # 'eed' goes first; the mark keeps it and the words left alone out of the next step.
        f"CASE WHEN suffix(w, 'eed') THEN '=' || CASE WHEN {measure('left(w, -3)')} > 0 THEN left(w, -1) ELSE w END "
        f"WHEN contains({shape(bare)}, '0') THEN {bare} ELSE '=' || w END",
        "CASE WHEN prefix(w, '=') THEN substr(w, 2) WHEN right(w, 2) IN ('at', 'bl', 'iz') THEN w || 'e' "
        f"WHEN len(w) > 1 AND right(w, 1) = left(right(w, 2), 1) AND suffix({shape('w')}, '1') AND right(w, 1) NOT IN ('l', 's', 'z') THEN left(w, -1) "
        f"WHEN {measure('w')} = 1 AND {cvc('w')} THEN w || 'e' ELSE w END",
        f"CASE WHEN suffix(w, 'y') AND contains({shape('left(w, -1)')}, '0') THEN left(w, -1) || 'i' ELSE w END",
        swapped(PORTER_2, 1), swapped(PORTER_3, 1), swapped(PORTER_4, 2, "ion"),
        f"CASE WHEN suffix(w, 'e') AND ({measure('left(w, -1)')} > 1 OR {measure('left(w, -1)')} = 1 AND NOT {cvc('left(w, -1)')}) THEN left(w, -1) ELSE w END",
        f"CASE WHEN suffix(w, 'll') AND {measure('w')} > 1 THEN left(w, -1) ELSE w END"]
    tables = [f"p0 AS (SELECT DISTINCT word, word AS w FROM {source})"]
    tables += [f"p{i} AS (SELECT word, CASE WHEN len(word) < 3 THEN w ELSE {step} END AS w FROM p{i - 1})" for i, step in enumerate(steps, 1)]
    return ", ".join([*tables, f"stemmed AS (SELECT word, w FROM p{len(steps)})"])


def labelset_votes(folds: str = "[0]", depth: int = 5, size: int = 3, words: int = 10_000) -> str:
    """Label-subset trees level by level, per held-out fold id % 10, up to votes (fold, id, tag, vote)."""
    labels = parsed('lower(tags)')
    parts = [f"""folds AS (SELECT unnest({folds}) AS fold),
kept AS (SELECT fold, t.* FROM train t, folds WHERE id % 10 <> fold), asked AS (SELECT fold, id FROM train, folds WHERE id % 10 = fold),
tok AS (SELECT id, 0 AS field, unnest({analysed('title')}) AS term FROM train UNION ALL SELECT id, 1, unnest({analysed('body')}) FROM train),
cnt AS MATERIALIZED (SELECT id, field, term, count(*) AS n FROM tok GROUP BY ALL),
voc AS (SELECT fold, field, term FROM (SELECT fold, field, term, row_number() OVER (PARTITION BY fold, field ORDER BY sum(n) DESC, term) AS r
  FROM cnt, folds WHERE id % 10 <> fold GROUP BY fold, field, term) WHERE r <= {words}),
feat AS MATERIALIZED (SELECT fold, id, field || '_' || term AS f FROM cnt JOIN voc USING (field, term)),
lab AS (SELECT DISTINCT fold, unnest({labels}) AS label FROM kept),
dealt AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY md5('1:' || label)) - 1 AS p, count(*) OVER (PARTITION BY fold) AS n
  FROM lab WHERE label <> ''),
groups AS (SELECT DISTINCT fold, p // least({size}, n) AS g FROM dealt),
first AS (SELECT g.fold, g.g AS ord, list_sort(list(d.label)) AS labels FROM groups g JOIN dealt d ON d.fold = g.fold
    AND (d.p // least({size}, n) = g.g OR ((g.g + 1) * least({size}, n) > n AND d.p < (g.g + 1) * least({size}, n) - n)) GROUP BY g.fold, g.g),
drawn AS (SELECT fold, 1000000 + s AS ord, list_sort(list(label)) AS labels FROM (
    SELECT fold, s, label, n, row_number() OVER (PARTITION BY fold, s ORDER BY md5('1:' || s || ':' || label)) AS r
    FROM (SELECT *, unnest(range(40 * n)) AS s FROM dealt)) WHERE r <= least({size}, n) GROUP BY fold, s),
ls AS MATERIALIZED (SELECT fold, labels, tree FROM (SELECT fold, labels, row_number() OVER (PARTITION BY fold ORDER BY min(ord)) - 1 AS tree
    FROM (SELECT * FROM first UNION ALL SELECT * FROM drawn) GROUP BY fold, labels)
  JOIN (SELECT fold, max(n) AS n FROM dealt GROUP BY fold) USING (fold) WHERE tree < 2 * n),
node0 AS (SELECT k.fold, k.id, tree, 1 AS node,
    list_sum(list_transform(labels, lambda x, i: CASE WHEN list_contains(own, x) THEN 1 << (i - 1)::INTEGER ELSE 0 END))::BIGINT AS pattern
  FROM (SELECT fold, id, {labels} AS own FROM kept) k JOIN ls USING (fold)),
asked0 AS (SELECT a.fold, a.id, tree, 1 AS node FROM asked a JOIN ls USING (fold))"""]
    for level in range(depth + 1):
        parts.append(f"tot{level} AS MATERIALIZED (SELECT fold, tree, node, pattern, count(*) AS t FROM node{level} GROUP BY ALL)")
        if level == depth:
            break
        parts.append(f"""all{level} AS (SELECT fold, tree, node, sum(t) AS t, sum(t * t) AS sq FROM tot{level} GROUP BY fold, tree, node),
has{level} AS (SELECT n.fold, n.tree, n.node, f, pattern, count(*) AS n FROM node{level} n JOIN feat USING (fold, id) GROUP BY ALL),
sum{level} AS (SELECT h.fold, h.tree, h.node, f, sum(n) AS np, sum(n * n) AS sp, sum(n * t) AS cr
  FROM has{level} h JOIN tot{level} USING (fold, tree, node, pattern) GROUP BY ALL),
best{level} AS MATERIALIZED (SELECT fold, tree, node, f FROM (
    SELECT s.fold, s.tree, s.node, f, round(sp::DOUBLE / np + (sq - 2 * cr + sp)::DOUBLE / (t - np), 6) AS score, round(sq::DOUBLE / t, 6) AS before
    FROM sum{level} s JOIN all{level} USING (fold, tree, node) WHERE t > np) WHERE score > before
  QUALIFY row_number() OVER (PARTITION BY fold, tree, node ORDER BY score DESC, f) = 1),
node{level + 1} AS MATERIALIZED (SELECT n.fold, n.id, n.tree, 2 * n.node + (x.f IS NOT NULL)::INTEGER AS node, n.pattern
  FROM node{level} n JOIN best{level} b USING (fold, tree, node) LEFT JOIN feat x ON x.fold = n.fold AND x.id = n.id AND x.f = b.f),
asked{level + 1} AS (SELECT n.fold, n.id, n.tree, CASE WHEN b.f IS NULL THEN n.node ELSE 2 * n.node + (x.f IS NOT NULL)::INTEGER END AS node
  FROM asked{level} n LEFT JOIN best{level} b USING (fold, tree, node) LEFT JOIN feat x ON x.fold = n.fold AND x.id = n.id AND x.f = b.f)""")
    leaves = " UNION ALL ".join(f"SELECT * FROM tot{level}" for level in range(depth + 1))
    parts.append(f"""leaf AS (SELECT fold, tree, node, arg_max(pattern, t * 1000 - pattern) AS pattern FROM ({leaves}) GROUP BY fold, tree, node),
votes AS (SELECT fold, id, tag, sum(yes)::DOUBLE / count(*) AS vote FROM (
    SELECT a.fold, a.id, unnest(labels) AS tag, unnest(list_transform(labels, lambda x, i: (pattern >> (i - 1)::INTEGER) & 1)) AS yes
    FROM asked{depth} a JOIN leaf USING (fold, tree, node) JOIN ls USING (fold, tree)) GROUP BY fold, id, tag HAVING sum(yes) * 2 >= count(*))""")
    return f"WITH {TRAIN}, " + ",\n".join(parts)


ORACLE: dict[str, str] = {
    "cross_validate_ml_knn": f"""WITH {CROSS_ML_KNN}
        SELECT f::INTEGER AS fold, round(wrong / (n_rows * k)::DOUBLE, 6) AS hamming_loss, round(1 - coalesce(bad, 0) / n_rows::DOUBLE, 6) AS subset_accuracy,
          round(2 * tp / (2 * tp + wrong)::DOUBLE, 6) AS micro_f1, round(f1 / k, 6) AS macro_f1, n_rows
        FROM sums JOIN m USING (f) LEFT JOIN bad USING (f), k""",
    "stem_vocabulary": f"""WITH {TRAIN}, words AS (SELECT DISTINCT unnest({analysed('body')}) AS word FROM train), {stems('words')}
        SELECT word, w AS term FROM stemmed""",
    "url_email_porter_totals": f"""WITH {TRAIN}, words AS (SELECT unnest({analysed('body', URL_EMAIL_WORD)}) AS word FROM train), {stems('words')}
        SELECT count(*) AS ttf, w AS term FROM words JOIN stemmed USING (word) GROUP BY w""",
    "questions_csv_round_trip": f"WITH {TRAIN} SELECT id, title, body, tags FROM train",
    "questions_csv_blocks": f"WITH {TRAIN} SELECT id, title, body, tags FROM train",
    "test_csv_round_trip": f"WITH {TEST} SELECT id, title, body, tags FROM test",
    "questions_table_round_trip": f"WITH {TRAIN} SELECT id, title, body, code, links, tags FROM train",
    "neighbor_lines_round_trip": f"WITH {neighbors()} SELECT query_id, rank, id, tags FROM nb",
    "quoted_neighbor_lines": f"""WITH {TRAIN} SELECT -id - 1 AS query_id, 1::INTEGER AS rank, id * -2 AS id,
        '"' || replace(tags, ' ', '",""') || ',1,"x"' AS tags FROM train""",
    "predictions_round_trip": f"WITH {TRAIN} SELECT id, tags FROM train",
    "score_lines_round_trip": f"WITH {TAG_SCORES} SELECT id, tag, score FROM scores",
    "example_lines_round_trip": f"""WITH {TRAIN}, cand AS (SELECT id, unnest({parsed('tags')}) AS tag FROM train),
        wb AS (SELECT id, term, count(*) AS n FROM (
          SELECT id, unnest({analysed('title')}) AS term FROM train UNION ALL SELECT id, unnest({analysed('body')}) FROM train) GROUP BY ALL),
        feat AS (SELECT id, string_agg(' _' || replace(term, ':', '_COLON_') || ':' || n, '' ORDER BY term) AS f FROM wb GROUP BY id)
        SELECT CASE WHEN c.id % 10 = 0 THEN '1' ELSE '-1' END || ' ' || c.id || '^' || c.tag || '|' || c.tag || ' ' || coalesce(f, '') AS value
        FROM cand c LEFT JOIN feat ON feat.id = c.id""",
    **{name: f"WITH {neighbors()} SELECT * FROM nb" for name in ("stored_index_search", "segmented_index_search")},
    "take_first": f"WITH {TRAIN} SELECT id, title, tags FROM train ORDER BY id LIMIT 100",
    "project_text": f"WITH {TRAIN} SELECT id, lower(title) || '!' AS text, tags FROM train",
    "concat_fields": f"WITH {TRAIN} SELECT id, {ALL_FIELDS} AS text FROM train",
    "slice_rows": f"WITH {TRAIN} SELECT id, (row_number() OVER (ORDER BY id) - 1) // 300 AS slice_id FROM train",
    "clean_code_pages": f"""WITH {TRAIN}, known AS (
          SELECT id, coalesce(body, '') AS b, coalesce(tags, '') AS g, coalesce(title, '') AS t FROM train)
        SELECT id, b || 'see ' || t || ' here and ' AS body, t || ' here' AS links,
          g || ' ' || id || chr(10) || id || chr(10) || g || chr(10) || 'in code' AS code FROM known""",
    "clean_html": f"SELECT page_id AS id, replace({decoded(PAGE_TEXT)}, chr(1), '</p>') AS body, "
                  f"'' AS code, {decoded(LINKS)} AS links FROM pages",
    "link_text": f"SELECT page_id AS id, {LINKS} AS links FROM pages",
    "raw_fields": "SELECT page_id AS id, html AS body, '' AS code, '' AS links FROM pages",
    "html_tag_counts": r"""SELECT tag, count(*) AS n FROM (SELECT lower(unnest(regexp_extract_all(regexp_replace(html,
        '<!--.*?(?:-->|\z)|(<script\b[^>]*>).*?(?:</script\s*>|\z)|(<style\b[^>]*>).*?(?:</style\s*>|\z)', '\1\2', 'gis'),
        '<([a-zA-Z][a-zA-Z0-9]*)', 1))) AS tag FROM pages) GROUP BY tag""",
    "tokenize_standard": f"""WITH {TRAIN}, t AS (SELECT id, {analysed('body')} AS toks FROM train)
        SELECT id, (generate_subscripts(toks, 1) - 1)::INTEGER AS pos, unnest(toks) AS term FROM t""",
    "url_email_tokens": f"""WITH {TRAIN}, t AS (SELECT unnest({analysed('body', URL_EMAIL_WORD)}) AS term FROM train)
        SELECT term, count(*) AS n FROM t WHERE regexp_full_match(term, '{URL_PATTERN}|{EMAIL_PATTERN}') GROUP BY term""",
    "remove_stop_words": f"""WITH {TRAIN}, t AS (SELECT unnest({analysed('body')}) AS term FROM train)
        SELECT term, count(*) AS n FROM t WHERE term NOT IN (SELECT source FROM documents)
        AND term NOT IN (SELECT lang FROM documents) AND term NOT IN ('die', 'que', 'los') GROUP BY term""",
    "max_token_length": f"""WITH {TRAIN}, t AS (SELECT id, unnest({analysed('body')}) AS term FROM train)
        SELECT id, count(*) AS n FROM t WHERE length(term) <= 6 GROUP BY id""",
    "analyzer_by_name": f"WITH {TRAIN} SELECT id, len({analysed('body', URL_EMAIL_WORD)}) AS doc_len FROM train",
    "word_bag": f"""WITH {TRAIN} SELECT id, term, count(*) AS n FROM (SELECT id, unnest({analysed('body')}) AS term FROM train
        UNION ALL SELECT id, unnest({analysed('title')}) FROM train) GROUP BY ALL""",
    "parse_tag_strings": f"WITH {TRAIN} SELECT id, array_to_string({parsed_in_order('title')}, '|') AS parsed FROM train",
    "index_docs": f"WITH {BOTH}, {indexed()} SELECT corpus, id, tags, doc_len FROM len",
    "index_postings": f"""WITH {BOTH}, {indexed()} SELECT p.corpus, p.id, p.term, p.tf, l.doc_len
        FROM post p JOIN len l ON l.corpus = p.corpus AND l.id = p.id""",
    "append_corpus": f"""WITH {BOTH}, {CHATS}, grown AS (SELECT * FROM both_ UNION ALL SELECT * FROM chats), {indexed('grown')}
        SELECT corpus, count(DISTINCT id) AS n_docs, sum(tf)::BIGINT AS n_tokens FROM post GROUP BY corpus""",
    "doc_freq": f"WITH {BOTH}, {indexed()} SELECT term, df FROM stats",
    "term_totals": f"WITH {BOTH}, {indexed()} SELECT ttf, term FROM stats ORDER BY ttf DESC, term",
    "corpus_stats": f"WITH {BOTH}, {indexed()} SELECT n_docs, sum_ttf, round(avgdl, 6) AS avgdl FROM n",
    "tag_counts": f"""WITH {TRAIN}, t AS (SELECT unnest(regexp_split_to_array(tags, '\\s')) AS tag FROM train)
        SELECT tag, count(*) AS n FROM t WHERE tag <> '' GROUP BY tag ORDER BY n, tag""",
    "tag_counts_keep_empty": f"""WITH {TRAIN}, t AS (SELECT unnest(regexp_split_to_array(title, '\\s')) AS tag FROM train)
        SELECT tag, count(*) AS n FROM t GROUP BY tag ORDER BY n, tag""",
    "separate_term_stats": f"""WITH {BOTH}, {CHATS}, {indexed()}, {indexed('chats', p='c_')},
        {selected(limit='lim.df BETWEEN 3 AND 200', limits_from='c_stats')}
        SELECT query_id, term, rank::INTEGER AS rank, df, micro::DOUBLE / 1000000 AS score FROM qt""",
    "source_tf": f"""WITH {TRAIN} SELECT query_id, term, count(*) AS tf FROM (
        SELECT id AS query_id, unnest(({analysed('body')})[1:50]) AS term FROM train) GROUP BY ALL""",
    "noise_filter": f"""WITH {TRAIN} SELECT query_id, term, count(*) AS tf FROM (
        SELECT id AS query_id, unnest({analysed('body')}) AS term FROM train)
        WHERE length(term) BETWEEN 4 AND 9 AND term NOT IN ('with', 'dans', 'para') GROUP BY ALL""",
    "min_term_freq": f"WITH {BOTH}, {indexed()}, {selected(min_tf=2)} SELECT query_id, term, tf, rank::INTEGER AS rank FROM qt",
    "doc_freq_limits": f"""WITH {BOTH}, {indexed()}, {selected(limit='s.df BETWEEN 5 AND 100')}
        SELECT query_id, term, df, rank::INTEGER AS rank FROM qt""",
    "max_doc_freq_pct": f"""WITH {BOTH}, {indexed()}, {selected(limit='s.df >= 1 AND s.df <= (7 * n_docs) // 100')}
        SELECT query_id, term, df, rank::INTEGER AS rank FROM qt""",
    "multi_field_stats": f"""WITH {TRAIN}, {indexed('train', 'title', p='a_')}, {indexed('train', 'body', p='b_')},
        {indexed('train', 'tags', p='c_')},
        f AS (SELECT 'title' AS field, 0 AS pos, term, df FROM a_stats UNION ALL SELECT 'body', 1, term, df FROM b_stats
          UNION ALL SELECT 'tags', 2, term, df FROM c_stats),
        r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY df DESC, pos) AS place FROM f)
        SELECT term, df, field AS top_field FROM r WHERE place = 1""",
    "query_terms": f"""WITH {BOTH}, {indexed()}, {selected(min_tf=2, limit='s.df >= 5')}
        SELECT query_id, term, tf, df, round(idf, 6) AS idf, micro::DOUBLE / 1000000 AS score, rank::INTEGER AS rank FROM qt""",
    "boosted_terms": f"""WITH {BOTH}, {indexed()},
        {selected(boost='2.0::DOUBLE * micro / max(micro) OVER (PARTITION BY query_id)')}
        SELECT query_id, term, rank::INTEGER AS rank, round(boost, 6) AS boost FROM qt""",
    "interesting_terms": f"""WITH {BOTH}, {indexed()}, {selected()}
        SELECT query_id, string_agg(term, ' ' ORDER BY rank) AS terms FROM qt GROUP BY query_id""",
    "terms_like_documents": f"""WITH {BOTH}, {indexed()},
        {selected('train', min_tf=2, limit='s.df >= 5')}
        SELECT query_id, term, tf, df, micro::DOUBLE / 1000000 AS score, rank::INTEGER AS rank FROM qt""",
    "term_details": f"""WITH {BOTH}, {indexed()}, {selected()} SELECT query_id, term AS word, 'text' AS top_field,
        micro::DOUBLE / 1000000 AS score, round(idf, 6) AS idf, df, tf FROM qt""",
    "bm25_idf": f"""WITH {BOTH}, {indexed()} SELECT term, df,
        round(ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 6) AS idf FROM stats, n""",
    "bm25_length_norm": f"""WITH {BOTH}, {indexed()} SELECT corpus, id, doc_len,
        round(1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * doc_len / avgdl), 6) AS norm FROM len, n""",
    "bm25_term": f"""WITH {BOTH}, {indexed()} SELECT d.corpus, d.id, d.term,
        round(ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (1.6::DOUBLE + 1)
          * (d.tf / (d.tf + 1.6::DOUBLE * (0.5::DOUBLE + 0.5::DOUBLE * doc_len / avgdl))), 6) AS score
        FROM post d JOIN stats s ON s.term = d.term JOIN len l ON l.corpus = d.corpus AND l.id = d.id, n""",
    "score_docs": f"""WITH {BOTH}, {indexed()}, {selected()} SELECT q.query_id, d.corpus, d.id,
        sum(round({BM25_WEIGHT} * ({BM25_IMPACT}) * 1000000)::BIGINT)::DOUBLE / 1000000 AS score
        FROM qt q JOIN post d ON d.term = q.term JOIN len l ON l.corpus = d.corpus AND l.id = d.id, n GROUP BY ALL""",
    "corpus_filter": f"""WITH {BOTH}, {indexed()}, {selected()}, {scored(where="d.corpus = 'test'")}, {best(3)}
        SELECT * FROM top""",
    "top_k": f"""WITH {BOTH}, {indexed()}, {selected()}, {scored(where="d.corpus = 'train'")}, {best(10)} SELECT * FROM top""",
    **{name: f"WITH {neighbors(text=ALL_FIELDS)} SELECT * FROM nb"
       for name in ("knn_join", "knn_join_one_plan", "knn_join_pruned")},
    "knn_by_id": f"""WITH {BOTH}, {indexed()}, asked AS (SELECT * REPLACE (id * 2 + CASE corpus WHEN 'test' THEN 1 ELSE 0 END AS id) FROM both_),
{selected('asked')}, {scored(where="d.corpus = 'train' AND q.query_id <> d.id * 2")}, {best(3)}, {TAGGED}
SELECT query_id, rank, id, score, tags FROM nb""",
    "knn_all_corpora": f"""WITH {BOTH}, {indexed()}, {selected()},
sc AS (SELECT q.query_id, d.corpus, d.id, sum(round({BM25_WEIGHT} * ({BM25_IMPACT}) * 1000000)::BIGINT)::BIGINT AS micro
  FROM qt q JOIN post d ON d.term = q.term JOIN len l ON l.corpus = d.corpus AND l.id = d.id, n GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY micro DESC, id, corpus) AS rank FROM sc)
SELECT t.query_id, t.rank::INTEGER AS rank, t.id, t.corpus, t.micro::DOUBLE / 1000000 AS score, l.tags
FROM top t JOIN len l ON l.id = t.id AND l.corpus = t.corpus WHERE t.rank <= 7""",
    "knn_multi_field": f"""WITH {BOTH},
fdoc AS (SELECT corpus, id, tags, 'title' AS field, 1 AS place, {analysed('title')} AS toks FROM both_
  UNION ALL SELECT corpus, id, tags, 'body', 2, {analysed('body')} FROM both_),
ftot AS (SELECT field, count(*) AS n_docs, sum(len(toks))::DOUBLE / count(*) AS avgdl FROM fdoc GROUP BY field),
fpost AS (SELECT corpus, id, field, place, len(toks) AS doc_len, term, count(*) AS tf
  FROM (SELECT *, unnest(toks) AS term FROM fdoc) GROUP BY ALL),
fstats AS (SELECT field, place, term, count(*) AS df FROM fpost GROUP BY ALL),
stats AS (SELECT term, max(df) AS df, arg_max(field, df * 10 - place) AS top_field FROM fstats GROUP BY term),
n AS (SELECT max(n_docs) AS n_docs FROM ftot), {selected()},
sc AS (SELECT q.query_id, d.id, sum(round({BM25_WEIGHT} * (d.tf / (d.tf + 1.2::DOUBLE * ((1.0::DOUBLE - 0.75) + 0.75::DOUBLE * d.doc_len / t.avgdl))) * 1000000)::BIGINT)::BIGINT AS micro
  FROM qt q JOIN stats s ON s.term = q.term JOIN fpost d ON d.term = q.term AND d.field = s.top_field JOIN ftot t ON t.field = d.field
  WHERE d.corpus = 'train' GROUP BY q.query_id, d.id), {best(5)}
SELECT t.query_id, t.rank, t.id, t.score, b.tags FROM top t JOIN train b ON b.id = t.id""",
    "knn_separate_stats": f"""WITH {BOTH}, {CHATS}, {indexed()}, {indexed('chats', p='c_')},
{selected(limit='lim.df >= 3 AND lim.df <= 200', limits_from='c_stats')}, {scored(where="d.corpus = 'train'")}, {best(5)}, {TAGGED}
SELECT query_id, rank, id, score, tags FROM nb""",
    "knn_self_join": f"""WITH {TRAIN}, {indexed('train')}, {selected('train')},
        {scored(where='d.id <> q.query_id')}, {best(3)}, {TAGGED} SELECT * FROM nb""",
    "neighbor_tags": f"""WITH {neighbors()}, packed AS (SELECT query_id, string_agg(',' || id || ',"' || tags || '"', '' ORDER BY rank) AS hits
        FROM nb GROUP BY query_id)
        SELECT test.id || coalesce(hits, '') AS value FROM test LEFT JOIN packed ON query_id = test.id""",
    "query_size": f"WITH {BOTH}, {indexed()}, {selected()} SELECT query_id, count(*) AS n_terms FROM qt GROUP BY query_id",
    "tfidf_neighbors": f"""WITH {BOTH}, {indexed()}, {selected(min_tf=2, limit='s.df >= 5')},
        {scored('q.boost * ln(1.0::DOUBLE + n.n_docs / q.df)', 'd.tf / l.doc_len', "d.corpus = 'train'")}, {best(5)}
        SELECT * FROM top""",
    "explain_scores": f"""WITH {BOTH}, {indexed()}, {selected()}, {scored(where="d.corpus = 'train'")}, {best(3)}
        SELECT t.query_id, t.id, q.term, q.boost::DOUBLE AS boost, round(q.idf, 6) AS idf, q.df, n.n_docs, d.tf,
          1.2::DOUBLE AS k1, 0.75::DOUBLE AS b, round(n.avgdl, 6) AS avgdl, l.doc_len,
          round(d.tf * 2.2::DOUBLE / (d.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l.doc_len / n.avgdl)), 6) AS tf_norm,
          round({BM25_WEIGHT} * ({BM25_IMPACT}) * 1000000) / 1000000 AS score
        FROM top t JOIN qt q ON q.query_id = t.query_id
        JOIN post d ON d.term = q.term AND d.id = t.id AND d.corpus = 'train'
        JOIN len l ON l.corpus = d.corpus AND l.id = d.id, n""",
    "candidate_tags": f"WITH {neighbors()}, {candidates(3)} SELECT id, tag FROM cand",
    "union_predict": f"WITH {neighbors()}, {union_tags(2, 'test')} SELECT id, tags FROM pred",
    "label_candidates": f"""WITH {held_out(5)}, {candidates(5)}, truth AS (SELECT id, unnest({parsed('tags')}) AS tag FROM asked)
        SELECT c.id, c.tag, CASE WHEN t.id IS NULL THEN -1 ELSE 1 END::INTEGER AS label
        FROM cand c LEFT JOIN truth t ON t.id = c.id AND t.tag = c.tag""",
    "format_examples": f"""WITH {held_out(3)}, {candidates(3)}, truth AS (SELECT id, unnest({parsed('tags')}) AS tag FROM asked), {WORDS},
        feat AS (SELECT id, string_agg(' _' || replace(term, ':', '_COLON_') || ':' || n, '' ORDER BY term) AS f FROM wb GROUP BY id)
        SELECT CASE WHEN t.id IS NULL THEN '-1' ELSE '1' END || ' ' || c.id || '^' || c.tag || '|' || c.tag || ' ' || coalesce(f, '') AS value
        FROM cand c LEFT JOIN truth t ON t.id = c.id AND t.tag = c.tag LEFT JOIN feat ON feat.id = c.id""",
    "predict_from_scores": f"""WITH {TAG_SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, tag) AS place FROM scores)
        SELECT id, coalesce(string_agg(tag, ' ' ORDER BY tag) FILTER (score > 0), max(tag) FILTER (place = 1)) AS tags FROM r GROUP BY id""",
    "predict_from_odd_scores": f"""WITH {TAG_SCORES}, odd AS (SELECT id, tag, CASE WHEN id % 5 = 0 OR (id + length(tag)) % 3 = 0 THEN NULL ELSE score END AS score FROM scores),
        r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC NULLS LAST, tag) AS place FROM odd)
        SELECT id, coalesce(string_agg(tag, ' ' ORDER BY tag) FILTER (score > 0), max(tag) FILTER (place = 1 AND score IS NOT NULL), '') AS tags FROM r GROUP BY id""",
    "repeated_truth": f"""WITH {TRAIN} SELECT id, len(list_distinct({parsed('tags')})) AS tp, len({parsed('tags')}) AS n_expected, false AS missing FROM train""",
    "per_row_scores": f"""WITH {held_out(5)}, {union_tags(2, 'asked')}, {ROW_SCORES}
        SELECT id, tp, n_predicted, n_expected, round("precision", 6) AS "precision", round(recall, 6) AS recall, missing FROM prs""",
    "mean_product_score": f"""WITH {held_out(5)}, {union_tags(1, 'asked')}, {ROW_SCORES}
        SELECT round(avg("precision" * recall), 6) AS mean_score, count(*) AS n_rows, count(*) FILTER (missing) AS n_missing FROM prs""",
    "mean_f1_score": f"""WITH {held_out(5)}, {union_tags(1, 'asked')}, {ROW_SCORES}
        SELECT round(avg(CASE WHEN "precision" + recall > 0 THEN 2 * "precision" * recall / ("precision" + recall) ELSE 0 END), 6) AS mean_score,
          count(*) AS n_rows, count(*) FILTER (missing) AS n_missing FROM prs""",
    "split_overlap": f"""WITH {SPLIT} SELECT count(*) AS n_test,
        count(*) FILTER (body IN (SELECT body FROM kept)) AS n_overlap FROM asked""",
    "sample_rows": f"WITH {TRAIN} SELECT id, title, tags FROM train ORDER BY id LIMIT 10000",
    "bag_of_words": bag(["title", "body", "tags"], 10000) + "SELECT id, feature, n FROM bow",
    "binarized_bag": bag(["title", "body", "tags"], 10000) + "SELECT id, feature, 1::BIGINT AS n FROM bow",
    "label_matrix": f"""WITH {TRAIN}, p AS (SELECT id, unnest({parsed('lower(tags)')}) AS label FROM train),
        v AS (SELECT label, (row_number() OVER (ORDER BY count(*) DESC, label) - 1)::INTEGER AS label_id FROM p GROUP BY label)
        SELECT id, label_id, label FROM p JOIN v USING (label) WHERE label_id < 10000""",
    "labelset_trees": labelset_votes() + " SELECT id, tag, vote FROM votes",
    "ml_knn": f"WITH {ML_KNN} SELECT id, label AS tag, round(yes / (yes + no), 6) AS probability FROM prob WHERE yes / (yes + no) > 0.5",
}
