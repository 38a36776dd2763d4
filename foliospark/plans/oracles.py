"""The queries in DuckDB's SQL, written from the rules and not from the plans."""

from __future__ import annotations

from foliospark.functions import porter, words
from foliospark.operators import answers, judge
from foliospark.operators import key_numbers as kn
from foliospark.plans import files
from foliospark.plans.catalog import PIECES
from foliospark.plans.corpus import QUESTIONS

SECTIONS = """
l_ AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
sec AS (SELECT doc_id, CAST(i AS INTEGER) AS sec_idx, ls[i + 1] AS text, array_to_string(string_split(ls[i + 1], ' ')[1:3], ' ') AS title, CAST(i % 3 + 1 AS INTEGER) AS level
  FROM (SELECT doc_id, ls, unnest(range(len(ls))) AS i FROM l_))"""

#: The parent is the last earlier section of a smaller level; ids and depth follow it down.
TREE = f"""{SECTIONS},
par AS (SELECT s.doc_id, s.sec_idx, any_value(s.level) AS level, any_value(s.text) AS text, any_value(s.title) AS title, max(p.sec_idx) AS parent_idx
  FROM sec s LEFT JOIN sec p ON p.doc_id = s.doc_id AND p.sec_idx < s.sec_idx AND p.level < s.level GROUP BY s.doc_id, s.sec_idx),
num AS (SELECT *, row_number() OVER (PARTITION BY doc_id, parent_idx ORDER BY sec_idx) AS nth FROM par),
tree AS (SELECT *, 0 AS depth, '§' || nth AS id, CAST(NULL AS VARCHAR) AS parent_id FROM num WHERE parent_idx IS NULL
  UNION ALL SELECT n.*, t.depth + 1, t.id || '.' || n.nth, t.id FROM num n JOIN tree t ON n.doc_id = t.doc_id AND n.parent_idx = t.sec_idx)"""


def listed(items: list[str]) -> str:
    return "(" + ", ".join("'" + i.replace("'", "''") + "'" for i in items) + ")"


def any_of(column: str, markers: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '" + m.replace("'", "''") + "')" for m in markers) + ")"


def word_count(c: str) -> str:
    return f"len(list_filter(regexp_split_to_array({c}, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> ''))"


def keyword_tokens(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '[a-z0-9][a-z0-9-]{{2,}}')"


KEYWORD_PARTS = f"""
t AS (SELECT doc_id, sec_idx, i, w[i] AS term FROM (SELECT doc_id, sec_idx, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, sec_idx, {keyword_tokens('text')} AS w FROM sec)) WHERE w[i] NOT IN {listed(words.KEYWORD_STOP)}),
h AS (SELECT doc_id, sec_idx, i, w[i] AS term FROM (SELECT doc_id, sec_idx, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, sec_idx, {keyword_tokens('title')} AS w FROM sec)) WHERE w[i] NOT IN {listed(words.KEYWORD_STOP)}),
f AS (SELECT doc_id, sec_idx, term, 1 AS part, CAST(0 AS DOUBLE) AS score, min(i) AS i FROM h GROUP BY doc_id, sec_idx, term
  UNION ALL SELECT doc_id, sec_idx, term, 2, -(CAST(count(*) AS DOUBLE) + CAST(0.1 AS DOUBLE) * CAST(length(term) AS DOUBLE)), min(i) FROM t GROUP BY doc_id, sec_idx, term),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sec_idx, term ORDER BY part) AS again FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sec_idx ORDER BY part, score, i) AS n FROM o WHERE again = 1),
k AS (SELECT doc_id, sec_idx, string_agg(term, ' ' ORDER BY n) AS keywords FROM r WHERE n <= 8 GROUP BY ALL)"""
KEYWORDS = f"WITH {SECTIONS},{KEYWORD_PARTS} SELECT doc_id, sec_idx, coalesce(keywords, '') AS keywords FROM sec LEFT JOIN k USING (doc_id, sec_idx)"

FIGURE_LINES = """
src AS (SELECT p_partkey AS doc_id, unnest(range(4)) AS line, [
  list_reduce(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), lambda a, b: a || ' ' || b) || ' price: $' || CAST(floor(p_retailprice) AS BIGINT),
  '1. Size of ' || p_name || ' is ' || p_size || ' now, up 12.5% in 3 weeks',
  'Figure ' || p_size || ' shows revenue of $1.2 billion and Model 7 in 1999, Q' || p_size || ' or rev-' || p_size,
  'Total stock: **' || p_partkey || '** and SKU ' || p_partkey || ' with speed gain 2.5x over 40 days'] AS ls FROM part),
ln AS (SELECT doc_id, CAST(line AS INTEGER) AS line, ls[line + 1] AS s FROM src)"""

_Q = chr(39)
FIGURES = f"""{FIGURE_LINES},
cut AS (SELECT doc_id, line, s, string_split(regexp_replace(s, '({kn.FIGURE})', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS p FROM ln),
one AS (SELECT doc_id, line, s, array_to_string(p[1:i - 1], '') AS lft, trim(p[i]) AS raw FROM (SELECT *, unnest(range(2, len(p), 2)) AS i FROM cut)),
knd AS (SELECT *, CASE WHEN raw LIKE '$%' THEN 'money' WHEN regexp_full_match(raw, '{kn.PERCENT}') THEN 'percent' WHEN regexp_full_match(raw, '{kn.DURATION}') THEN 'duration'
  WHEN regexp_matches(raw, '[x×]$') THEN 'ratio' ELSE 'count' END AS kind FROM one),
num_ AS (SELECT *, CASE WHEN regexp_matches(lower(raw), '\\btrillion\\b') THEN 1e12 WHEN regexp_matches(lower(raw), '\\bbillion\\b') THEN 1e9 WHEN regexp_matches(lower(raw), '\\bmillion\\b') THEN 1e6 WHEN regexp_matches(lower(raw), '\\bthousand\\b') THEN 1e3 ELSE 1 END
  * TRY_CAST(regexp_extract(replace(lower(raw), ',', ''), '-?\\d+(\\.\\d+)?') AS DOUBLE) * CASE WHEN regexp_matches(replace(lower(raw), ',', ''), '^[^0-9]*\\d+(\\.\\d+)?k') THEN 1e3 ELSE 1 END AS value FROM knd),
fil AS (SELECT *, regexp_extract(regexp_replace(lft, '\\s+$', ''), '{kn.INLINE_LABEL}', 1) AS inl, regexp_extract_all(lft, '{kn.LABEL_WORD}') AS ws FROM num_
  WHERE length(lft) >= length(regexp_extract(s, '{kn.LIST_MARKER}')) AND NOT regexp_matches(lft, '[A-Za-z]-?$')
  AND NOT regexp_matches(trim(regexp_extract(rtrim(lft), '[^ ]+$'), '.,'), '^[A-Z]{{2,}}$') AND NOT (kind = 'count' AND coalesce(value BETWEEN 1900 AND 2099, false) AND NOT contains(raw, '.'))),
lab AS (SELECT *, CASE WHEN inl <> '' THEN trim(inl, ' *(') ELSE array_to_string(list_filter(ws, lambda w: lower(w) NOT IN {listed(words.LABEL_FILLERS)})[-4:], ' ') END AS label FROM fil),
fig AS (SELECT * FROM lab WHERE label <> '' AND NOT (kind = 'count' AND inl = '' AND (coalesce(lower(ws[-1]), '') IN {listed(words.REFERENCE_WORDS)} OR (NOT contains(label, ' ') AND regexp_matches(label, '^[A-Z]')))))"""

NUMBERS = f"""{FIGURES},
fst AS (SELECT doc_id, lower(label) AS low, raw, arg_min(label, line * 10000 + length(lft)) AS label, arg_min(kind, line * 10000 + length(lft)) AS kind, min(line * 10000 + length(lft)) AS pos FROM fig GROUP BY doc_id, lower(label), raw),
kns AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS kn_idx, label, raw AS value, CASE WHEN kind = 'percent' THEN '%' WHEN raw LIKE '$%' THEN 'USD' END AS unit FROM fst)"""

STEM = "CASE WHEN contains(regexp_extract({p}, '[^/\\\\]*$'), '.') THEN regexp_replace(regexp_extract({p}, '[^/\\\\]*$'), '\\.[^.]*$', '') ELSE regexp_extract({p}, '[^/\\\\]*$') END"
_PATH = "'/data/in/' || p_brand || '_' || list_reduce(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), lambda a, b: a || ' ' || b) || p_size || 'b.v2.Csv'"

ASKED = "q AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{q.replace(_Q, _Q * 2)}')" for i, q in enumerate(QUESTIONS)) + ") AS x(qid, question))"
ASCII_LOW = "translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def index_tokens(c: str) -> str:
    return f"list_filter(regexp_split_to_array({ASCII_LOW.format(c=c)}, '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]+'), lambda x: x <> '')"


def query_units(c: str) -> str:
    full = f"list_filter(regexp_split_to_array(regexp_replace(lower({c}), '[^a-z0-9-]', ' ', 'g'), ' +'), lambda x: length(x) > 1)"
    keywords = f"list_filter({full}, lambda x: length(x) > 2 AND x NOT IN {listed(words.RETRIEVAL_STOP)})"
    return f"CASE WHEN len({keywords}) > 0 THEN {keywords} WHEN len({full}) > 0 THEN {full} ELSE [{c}] END"


TOKENS = f"""
both_ AS (SELECT doc_id, sec_idx, 0 AS col, {index_tokens('title')} AS ts FROM sec UNION ALL SELECT doc_id, sec_idx, 1, {index_tokens('text')} FROM sec),
tok AS (SELECT doc_id, sec_idx, col, i AS pos, ts[i + 1] AS term FROM (SELECT *, unnest(range(len(ts))) AS i FROM both_)),
len_ AS (SELECT doc_id, sec_idx, CAST(sum(len(ts)) AS BIGINT) AS length FROM both_ GROUP BY ALL)"""


# Porter's rules as regular expressions: C and V are runs of consonants and vowels, y being a vowel after a consonant.
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_MEASURE1, _MEASURE2, _ONE = f"^({_C})?{_V}{_C}", f"^({_C})?{_V}{_C}{_V}{_C}", f"^({_C})?{_V}{_C}({_V})?$"
_VOWEL, _SHORT = f"^({_C})?[aeiouy]", f"^{_C}[aeiouy][^aeiouwxy]$"


def _cut(n: int) -> str:
    return f"left(x, length(x) - {n})"


def _swapped(rules: dict[str, str]) -> str:
    cases = [f"WHEN x LIKE '%{e}' THEN CASE WHEN regexp_matches({_cut(len(e))}, '{_MEASURE1}') THEN {_cut(len(e))} || '{to}' ELSE x END" for e, to in sorted(rules.items(), key=lambda r: -len(r[0]))]
    return f"CASE {' '.join(cases)} ELSE x END"


def stemmed(words_: str) -> str:
    """stm (w, s): the stem of every w of the relation `words_`."""
    four = " ".join(
        f"WHEN x LIKE '%{e}' THEN CASE WHEN regexp_matches({_cut(len(e))}, '{_MEASURE2}')" + (f" AND regexp_matches({_cut(3)}, '[st]$')" if e == "ion" else "") + f" THEN {_cut(len(e))} ELSE x END" for e in sorted(porter.STEP4, key=len, reverse=True)
    )
    steps = (
        f"CASE WHEN x LIKE '%sses' OR x LIKE '%ies' THEN {_cut(2)} WHEN x LIKE '%ss' THEN x WHEN x LIKE '%s' THEN {_cut(1)} ELSE x END",
        f"CASE WHEN x LIKE '%eed' THEN CASE WHEN regexp_matches({_cut(3)}, '{_MEASURE1}') THEN {_cut(1)} ELSE x END WHEN x LIKE '%ed' AND regexp_matches({_cut(2)}, '{_VOWEL}') THEN {_cut(2)} || '*' WHEN x LIKE '%ing' AND regexp_matches({_cut(3)}, '{_VOWEL}') THEN {_cut(3)} || '*' ELSE x END",
        # a star marks a word that has lost its ending
        f"CASE WHEN NOT x LIKE '%*' THEN x WHEN regexp_matches(x, '(at|bl|iz)\\*$') THEN {_cut(1)} || 'e' WHEN length(x) > 2 AND x[-2] = x[-3] AND regexp_matches(x, '[^aeioulsz]\\*$') THEN {_cut(2)} WHEN regexp_matches({_cut(1)}, '{_ONE}') AND regexp_matches({_cut(1)}, '{_SHORT}') THEN {_cut(1)} || 'e' ELSE {_cut(1)} END",
        f"CASE WHEN x LIKE '%y' AND regexp_matches({_cut(1)}, '{_VOWEL}') THEN {_cut(1)} || 'i' ELSE x END",
        _swapped(porter.STEP2), _swapped(porter.STEP3), f"CASE {four} ELSE x END",
        f"CASE WHEN x LIKE '%e' AND (regexp_matches({_cut(1)}, '{_MEASURE2}') OR regexp_matches({_cut(1)}, '{_ONE}') AND NOT regexp_matches({_cut(1)}, '{_SHORT}')) THEN {_cut(1)} ELSE x END",
        f"CASE WHEN x LIKE '%ll' AND regexp_matches({_cut(1)}, '{_MEASURE2}') THEN {_cut(1)} ELSE x END",
    )
    chain = [f"st0 AS (SELECT w, w AS x FROM {words_} WHERE regexp_full_match(w, '[a-z]{{3,20}}'))"]
    chain += [f"st{n} AS (SELECT w, {sql} AS x FROM st{n - 1})" for n, sql in enumerate(steps, 1)]
    return ",\n".join([*chain, f"stm AS (SELECT w, x AS s FROM st{len(steps)} UNION ALL SELECT w, w FROM {words_} WHERE NOT regexp_full_match(w, '[a-z]{{3,20}}'))"])


def bm25(asked: str, scope: str, stem: bool = False, sections: str = SECTIONS) -> str:
    """sco: (qid, doc_id, sec_idx, score); `asked` defines q(qid, question[, only_])."""
    if stem:
        plain = bm25(asked, scope, sections=sections)
        own = f"vt AS (SELECT term AS w FROM tok0 UNION SELECT term FROM wt0), {stemmed('vt')},\ntok AS (SELECT doc_id, sec_idx, col, pos, s AS term FROM tok0 JOIN stm ON term = w), wt AS (SELECT qid, u, m, nth, s AS term FROM wt0 JOIN stm ON term = w),\nhit AS ("
        return plain.replace("tok AS (", "tok0 AS (").replace("wt AS (", "wt0 AS (").replace("hit AS (", own)
    per = "d." if scope == "document" else ""
    keys = ", doc_id" if scope == "document" else ""
    only = " WHERE q.only_ IS NULL OR q.only_ = t.doc_id" if "only_" in asked else ""
    return f"""{sections},{TOKENS},{asked},
un AS (SELECT DISTINCT qid, u FROM (SELECT qid, unnest({query_units('question')}) AS u FROM q)),
pt AS (SELECT qid, u, {index_tokens('u')} AS ws FROM un),
wt AS (SELECT qid, u, len(ws) AS m, i AS nth, ws[i + 1] AS term FROM (SELECT *, unnest(range(len(ws))) AS i FROM pt)),
hit AS (SELECT w.qid, w.u, w.m, t.doc_id, t.sec_idx, t.col, t.pos - w.nth AS start, count(DISTINCT nth) AS c FROM tok t JOIN wt w USING (term) JOIN q USING (qid){only} GROUP BY ALL),
occ AS (SELECT qid, u, doc_id, sec_idx, count(*) AS f FROM hit WHERE c = m GROUP BY ALL),
sta AS (SELECT {'doc_id, ' if keys else ''}count(*) AS n_all, avg(length) AS mean FROM len_ {'GROUP BY doc_id' if keys else ''}),
nn AS (SELECT qid, u{keys}, count(*) AS n FROM occ GROUP BY ALL),
prt AS (SELECT o.qid, o.doc_id, o.sec_idx, CASE WHEN ln((n_all - n + 0.5) / (n + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_all - n + 0.5) / (n + 0.5)) END
  * (f * CAST(2.2 AS DOUBLE)) / (f + CAST(1.2 AS DOUBLE) * (1 - CAST(0.75 AS DOUBLE) + CAST(0.75 AS DOUBLE) * length / mean)) AS s
  FROM occ o JOIN nn ON o.qid = nn.qid AND o.u = nn.u{' AND o.doc_id = nn.doc_id' if keys else ''} JOIN len_ l ON o.doc_id = l.doc_id AND o.sec_idx = l.sec_idx JOIN sta ON {'sta.doc_id = o.doc_id' if keys else 'true'}),
sco AS (SELECT qid, doc_id, sec_idx, sum(s) AS score FROM prt GROUP BY ALL)"""


def content_tokens(c: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda x: length(x) > 2 AND x NOT IN {listed(words.QUESTION_FILLERS)}))"


EXCHANGES = "x AS (SELECT a.conv_id, a.turn, a.text AS question, b.text AS answer FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user')"


def confidence(q: str, s: str) -> str:
    have = f"list_filter(regexp_extract_all(lower({s}), '[a-z0-9]+'), lambda y: length(y) > 2)"
    return f"CASE WHEN len({content_tokens(q)}) = 0 THEN 0 ELSE len(list_intersect({content_tokens(q)}, {have})) / CAST(len({content_tokens(q)}) AS DOUBLE) END"


def extractive(source: str, key: str) -> str:
    """ext({key}, extract) from rows of `source` with `question` and `answer`."""
    return f"""
sen AS (SELECT {key}, {content_tokens('question')} AS asked, list_filter(list_transform(string_split(regexp_replace(answer, '([.!?])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(1), 'g'), chr(1)), lambda y: trim(y, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda y: length(y) > 15) AS ss FROM {source}),
sc_ AS (SELECT {key}, i, ss[i] AS s, len(list_filter(regexp_extract_all(lower(ss[i]), '[a-z0-9]+'), lambda y: list_contains(asked, y))) AS c FROM (SELECT *, unnest(range(1, len(ss) + 1)) AS i FROM sen)),
rk_ AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY c DESC, i) AS r, max(c) OVER (PARTITION BY {key}) AS best FROM sc_),
ext AS (SELECT {key}, string_agg(s, ' ' ORDER BY i) AS extract FROM rk_ WHERE r <= 2 AND best > 0 GROUP BY ALL)"""


LISTS = f"""{SECTIONS},
ra AS (SELECT doc_id AS qid, sec_idx, row_number() OVER (PARTITION BY doc_id ORDER BY length(text) DESC, sec_idx) - 1 AS rank FROM sec),
rb AS (SELECT doc_id AS qid, sec_idx, row_number() OVER (PARTITION BY doc_id ORDER BY length(text) - length(replace(text, ',', '')) DESC, sec_idx) - 1 AS rank FROM sec)"""

EDGES = """
lin AS (SELECT doc_id, sec_idx AS a, parent_idx AS b FROM tree WHERE parent_idx IS NOT NULL),
edge AS (SELECT doc_id, a AS from_idx, b AS to_idx, 'parent' AS edge_type, CAST(1 AS DOUBLE) AS weight FROM lin UNION ALL SELECT doc_id, b, a, 'child', 1 FROM lin
  UNION ALL SELECT x.doc_id, x.a, y.a, 'sibling', CAST(0.8 AS DOUBLE) FROM lin x JOIN lin y ON x.doc_id = y.doc_id AND x.b = y.b AND x.a <> y.a)"""

ALPHA = "CASE edge_type WHEN 'child' THEN CAST(0.15 AS DOUBLE) WHEN 'sibling' THEN CAST(0.1 AS DOUBLE) WHEN 'semantic' THEN CAST(0.12 AS DOUBLE) ELSE 0 END"

PART_ASKED = """
pq AS (SELECT p_partkey AS qid, CASE p_partkey % 5 WHEN 0 THEN 'Give me a summary' WHEN 1 THEN 'What is the price of ' || p_name || '?' WHEN 2 THEN 'List all prices ' WHEN 3 THEN 'figure revenue shows model now' ELSE 'any insights on the stock' END AS question,
  CASE WHEN p_size > 25 THEN 'About ' || p_name END AS summary, CASE WHEN p_size % 2 = 0 THEN [p_brand, p_type] ELSE [] END AS insights FROM part)"""


def singular(c: str) -> str:
    return f"list_transform(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda w: CASE WHEN length(w) > 3 AND w LIKE '%s' AND NOT w LIKE '%ss' THEN w[:-2] ELSE w END)"


MATCHED = f"""
pl_ AS (SELECT *, list_filter({singular('label')}, lambda w: w NOT IN {listed(words.QUESTION_FILLERS)}) AS plain FROM kns),
co_ AS (SELECT *, CASE WHEN len(list_filter(plain, lambda w: w NOT IN {listed(words.SOFT_WORDS)})) > 0 THEN list_filter(plain, lambda w: w NOT IN {listed(words.SOFT_WORDS)}) ELSE plain END AS core FROM pl_),
ca_ AS (SELECT qid, question, kn_idx, label, value, unit, len(core) AS n, max(len(core)) OVER (PARTITION BY qid) AS best FROM co_ JOIN pq ON doc_id = qid WHERE len(core) > 0 AND list_has_all({singular('question')}, core)),
mat AS (SELECT qid, arg_min(label, kn_idx) AS label, arg_min(value, kn_idx) AS value, arg_min(unit, kn_idx) AS unit FROM ca_ WHERE n = best GROUP BY qid HAVING count(DISTINCT value) = 1)"""

INT8 = """
m AS (SELECT vec_id, embedding AS v, CAST(CAST(127 AS DOUBLE) / CAST(CAST(coalesce(list_max(list_transform(embedding, lambda x: abs(x))), 0) AS FLOAT) + CAST(1e-8 AS FLOAT) AS DOUBLE) AS FLOAT) AS scale FROM embeddings),
c AS (SELECT vec_id, list_transform(v, lambda x: CAST(trunc(least(greatest(CAST(x * scale AS FLOAT), CAST(-127 AS FLOAT)), CAST(127 AS FLOAT))) AS INTEGER)) AS q FROM m)"""

_DENORM = "regexp_replace(regexp_replace(replace({c}, ',', ''), '(\\d)[ \\t\\n\\x0B\\f\\r]+(\\d\\d\\d)\\b', '\\1\\2', 'g'), '(\\d)[ \\t\\n\\x0B\\f\\r]+(\\d\\d\\d)\\b', '\\1\\2', 'g')"
_STRIP = "trim(lower({c}), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
JUDGED = f"""{EXCHANGES},
j0 AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 2 THEN 'Not found in the context' ELSE answer || ' count: ' || (conv_id * 100 + turn * 3) || '; 1 234 items = 57' END AS candidate,
  CASE WHEN conv_id % 2 = 0 THEN answer ELSE question END || ' count: ' || (conv_id * 100 + turn * 5) || '; 1 234 items = 57' AS reference FROM x),
j1 AS (SELECT conv_id, turn, {_STRIP.format(c='candidate')} AS c, {_STRIP.format(c='reference')} AS r FROM j0),
j2 AS (SELECT *, regexp_extract_all({_DENORM.format(c="regexp_replace(r, '§[ ]*[0-9.]+|\\bsection[ ]+[0-9.]+', ' ', 'g')")}, '\\b\\d[0-9.]*') AS rn, regexp_extract_all({_DENORM.format(c='c')}, '\\b\\d[0-9.]*') AS cn,
  list_filter(regexp_split_to_array(regexp_replace(r, '[^a-z0-9]', ' ', 'g'), ' +'), lambda w: w <> '') AS rw, list_filter(regexp_split_to_array(regexp_replace(c, '[^a-z0-9]', ' ', 'g'), ' +'), lambda w: w <> '') AS cw,
  {_DENORM.format(c="regexp_extract(r, '=[ ]*([0-9][0-9, ]*[0-9]|[0-9])', 1)")} AS res,
  list_filter(list_transform(regexp_split_to_array(r, '[;|:–-]'), lambda p: trim(p, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda p: length(p) > 4 AND length(p) < 60) AS ph FROM j1),
near AS (SELECT a.conv_id, a.turn, a.i, bool_or(CASE WHEN TRY_CAST(a.v AS DOUBLE) IS NOT NULL AND TRY_CAST(b.v AS DOUBLE) IS NOT NULL THEN abs(TRY_CAST(a.v AS DOUBLE) - TRY_CAST(b.v AS DOUBLE)) / greatest(abs(TRY_CAST(a.v AS DOUBLE)), 0.001) < 0.06 ELSE a.v = b.v END) AS hit
  FROM (SELECT conv_id, turn, unnest(range(len(rn) + 1)) AS i, unnest(list_append(rn, res)) AS v FROM j2) a JOIN (SELECT conv_id, turn, unnest(cn) AS v FROM j2) b ON a.conv_id = b.conv_id AND a.turn = b.turn GROUP BY ALL),
nh AS (SELECT n.conv_id, n.turn, count(*) FILTER (WHERE hit AND i < len(rn)) AS hits, bool_or(hit AND i = len(rn) AND res <> '') AS rh FROM near n JOIN j2 ON n.conv_id = j2.conv_id AND n.turn = j2.turn GROUP BY ALL),
kw AS (SELECT *, list_distinct(list_filter(rw, lambda w: length(w) > 2 AND w NOT IN {listed(words.RETRIEVAL_STOP)})) AS want FROM j2),
j3 AS (SELECT k.conv_id, k.turn, k.c, len(rn) AS n_rn, greatest(coalesce(hits, 0) / CAST(greatest(len(rn), 1) AS DOUBLE), CASE WHEN coalesce(rh, false) THEN 1 ELSE 0 END) AS num_ratio,
  len(list_intersect(want, cw)) / CAST(greatest(len(want), 1) AS DOUBLE) AS kw_ratio, len(list_filter(ph, lambda p: contains(c, p))) / CAST(greatest(len(ph), 1) AS DOUBLE) AS phrase_ratio
  FROM kw k LEFT JOIN nh ON k.conv_id = nh.conv_id AND k.turn = nh.turn),
j4 AS (SELECT *, CAST(0.5 AS DOUBLE) * num_ratio + CAST(0.3 AS DOUBLE) * kw_ratio + CAST(0.2 AS DOUBLE) * phrase_ratio AS b FROM j3)"""


def hybrid(stem: bool) -> str:
    return (
        f"WITH RECURSIVE {bm25('q AS (SELECT doc_id AS qid, doc_id AS only_, title AS question FROM sec WHERE sec_idx = 1)', 'document', stem)},{TREE.replace(SECTIONS + ',', '')},{EDGES}, r0 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, sec_idx) - 1 AS rank FROM sco), f AS (SELECT qid, sec_idx, CAST(2 AS DOUBLE) / (rank + 61) AS s FROM r0 WHERE rank < 24), u AS (SELECT * FROM f UNION ALL SELECT qid, to_idx, {ALPHA} * weight * s FROM f JOIN edge ON qid = doc_id AND sec_idx = from_idx WHERE edge_type <> 'parent'), g AS (SELECT qid, sec_idx, sum(s) AS score FROM u GROUP BY qid, sec_idx), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, sec_idx) - 1 AS rank FROM g) SELECT qid, sec_idx, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM r WHERE rank < 8"
    )


NEW_SECTIONS = SECTIONS.replace("FROM documents)", "FROM documents WHERE doc_id % 7 <> 0)")
RANKED = "r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, doc_id, sec_idx) - 1 AS rank FROM sco) SELECT CAST(qid AS BIGINT) AS qid, doc_id, sec_idx, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM r WHERE rank < 24"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _reply(prompt: str) -> str:
    return f"CASE WHEN length({prompt}) % 3 = 0 THEN 'I''m sorry, that is not found here.' ELSE {prompt}[-40:] END"


def _refused(reply: str) -> str:
    return f"(trim({reply}) = '' OR {any_of(f'lower({reply}[1:160])', words.REFUSAL_MARKERS)})"


# Layers 0 and 1 as in layer_route; the prompts of the others, and what a stand-in model says to them.
_ASK = "chr(10) || chr(10) || 'Question: ' || question"
_HINT = f"CASE WHEN {any_of('lower(trim(question))', words.ENUMERATION_MARKERS)} THEN {_quoted(answers.ENUMERATE)} ELSE '' END"
_MORE = "'[§2] More' || chr(10) || 'of ' || p_brand"
LAYERED = f"""WITH {NUMBERS},{PART_ASKED},{MATCHED},
tx AS (SELECT doc_id, string_agg(s, chr(10) ORDER BY line) AS answer FROM ln GROUP BY doc_id),
z AS (SELECT pq.qid, pq.question, tx.answer, CASE WHEN {any_of('lower(question)', words.SUMMARY_MARKERS)} THEN summary WHEN {any_of('lower(question)', words.INSIGHT_MARKERS)} THEN CASE WHEN len(insights) > 0 THEN array_to_string(list_transform(insights, lambda i: '• ' || i), chr(10)) END
  WHEN NOT {any_of('lower(trim(question))', words.COMPLEX_MARKERS)} AND label IS NOT NULL THEN label || ': ' || value || CASE WHEN coalesce(unit, '') <> '' THEN ' ' || unit ELSE '' END || ' (source: §1)' END AS zero
  FROM pq LEFT JOIN mat ON pq.qid = mat.qid JOIN tx ON pq.qid = tx.doc_id),
y AS (SELECT *, {confidence('question', 'answer')} AS conf FROM z),{extractive('z', 'qid')},
u AS (SELECT y.*, p_size % 2 = 0 AS more, p_brand, CASE WHEN conf >= 0.6 AND NOT {any_of('lower(trim(y.question))', words.COMPLEX_MARKERS)} THEN extract END AS one FROM y LEFT JOIN ext ON y.qid = ext.qid JOIN part ON p_partkey = y.qid),
w1 AS (SELECT *, {_quoted(answers.TELL2.replace('{top}', '§1'))} || answer[1:{answers.SECTION_CHARS}] || {_ASK} AS p2,
  {_quoted(answers.TELL3)} || {_HINT} || chr(10) || chr(10) || '[§1] ' || chr(10) || answer[1:{answers.MULTI_CHARS}] || CASE WHEN more THEN chr(10) || chr(10) || {_MORE} ELSE '' END || {_ASK} AS p3,
  {_quoted(answers.TELL4)} || {_HINT} || chr(10) || chr(10) || '[§1] ' || chr(10) || answer[1:{answers.FALLBACK_CHARS}] || CASE WHEN more THEN chr(10) || chr(10) || {_MORE} ELSE '' END || {_ASK} AS p4 FROM u),
w2 AS (SELECT *, {_reply('p2')} AS r2, {_reply('p3')} AS r3, {_reply('p4')} AS r4 FROM w1),
w3 AS (SELECT *, CASE WHEN zero IS NOT NULL THEN 0 WHEN one IS NOT NULL THEN 1 WHEN conf >= {answers.L2} AND NOT ({_refused('r2')} AND more) THEN 2 WHEN more AND NOT {_refused('r3')} THEN 3 ELSE 4 END AS layer FROM w2)
SELECT qid, CASE layer WHEN 0 THEN zero WHEN 1 THEN one WHEN 2 THEN r2 WHEN 3 THEN r3 ELSE r4 END AS answer,
  CASE WHEN layer = 0 THEN '' WHEN layer < 3 THEN '§1' WHEN more THEN '§1 §2' ELSE '§1' END AS citations, CAST(layer AS INTEGER) AS layer_used,
  CAST(CASE layer WHEN 2 THEN {word_count('p2')} + {word_count('r2')} WHEN 3 THEN {word_count('p3')} + {word_count('r3')} WHEN 4 THEN {word_count('p4')} + {word_count('r4')} ELSE 0 END AS INTEGER) AS tokens_used,
  round(CASE layer WHEN 0 THEN 1 WHEN 3 THEN 0.6 WHEN 4 THEN 0.4 ELSE conf END, 6) AS confidence FROM w3"""

_VOCABULARY = ", ".join(f"({i}, '{p}')" for i, p in enumerate(PIECES))
WORDPIECES = f"""WITH RECURSIVE voc AS (SELECT id, p LIKE '##%' AS inner_, CASE WHEN p LIKE '##%' THEN p[3:] ELSE p END AS body FROM (VALUES {_VOCABULARY}) AS x(id, p)),
ws AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}\\s]') AS ws FROM benchmark),
one AS (SELECT item_id, i, ws[i] AS w FROM (SELECT item_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM ws)),
pos AS (SELECT w, unnest(range(length(w))) AS pos FROM (SELECT DISTINCT w FROM one)),
best AS (SELECT w, pos, arg_max(id, length(body)) AS id, max(length(body)) AS n FROM pos JOIN voc ON inner_ = (pos > 0) AND starts_with(w[pos + 1:], body) GROUP BY w, pos),
path AS (SELECT DISTINCT w, CAST(0 AS BIGINT) AS pos, CAST([] AS BIGINT[]) AS ids FROM pos UNION ALL SELECT p.w, p.pos + b.n, list_append(p.ids, b.id) FROM path p JOIN best b ON p.w = b.w AND p.pos = b.pos),
done AS (SELECT w, ids FROM path WHERE pos = length(w) AND length(w) <= 200),
al AS (SELECT item_id, flatten(list(coalesce(ids, [{PIECES.index('[UNK]')}]) ORDER BY i)) AS ids FROM one LEFT JOIN done ON one.w = done.w GROUP BY item_id)
SELECT item_id, array_to_string(list_concat(list_concat([{PIECES.index('[CLS]')}], coalesce(ids, [])[1:254]), [{PIECES.index('[SEP]')}]), ' ') AS ids FROM benchmark LEFT JOIN al USING (item_id)"""

ORACLES = {
    "section_tree": f"WITH RECURSIVE {TREE} SELECT doc_id, sec_idx, level, CAST(depth AS INTEGER) AS depth, parent_idx, id, parent_id, CAST(floor({word_count('text')} * CAST(1.3 AS DOUBLE)) AS INTEGER) AS token_count FROM tree",
    "section_children": f"WITH RECURSIVE {TREE}, c AS (SELECT doc_id, parent_idx AS sec_idx, count(*) AS n, string_agg(id, ' ' ORDER BY sec_idx) AS ids FROM tree WHERE parent_idx IS NOT NULL GROUP BY doc_id, parent_idx) SELECT t.doc_id, t.sec_idx, CAST(coalesce(n, 0) AS INTEGER) AS n_children, coalesce(ids, '') AS children FROM tree t LEFT JOIN c ON t.doc_id = c.doc_id AND t.sec_idx = c.sec_idx",
    "table_normalise": """WITH c AS (SELECT p_partkey, p_size, string_split(p_name || ' ' || p_type || ' ' || p_brand, ' ') AS w FROM part),
r AS (SELECT p_partkey, p_size, [w, w[1:1], list_concat(w, w)] AS rows_ FROM c)
SELECT p_partkey, array_to_string(list_transform(rows_, lambda x: array_to_string(CASE WHEN p_size % 5 = 0 THEN x ELSE list_concat(x, ['', '', ''])[1:3] END, '|')), '/') AS fitted FROM r""",
    "keywords_topk": KEYWORDS,
    "figures": f"WITH {FIGURES} SELECT doc_id, line, raw, kind, label, round(value, 6) AS value FROM fig",
    "key_numbers_top": f"WITH {NUMBERS} SELECT doc_id, kn_idx, label, value, unit FROM kns WHERE kn_idx < 6",
    "doc_slug": f"""WITH p AS (SELECT p_partkey, {_PATH} AS path FROM part), s AS (SELECT p_partkey, {STEM.format(p='path')} AS st FROM p)
SELECT p_partkey, trim(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(st, '([a-z])([A-Z])', '\\1-\\2', 'g'), '([A-Za-z])([0-9])', '\\1-\\2', 'g'), '([0-9])([A-Za-z])', '\\1-\\2', 'g'), '[\\s_-]+', '-', 'g')), '-') AS slug,
array_to_string(list_transform(string_split(regexp_replace(st, '[-_]+', ' ', 'g'), ' '), lambda w: CASE WHEN upper(w) = w AND length(w) > 1 THEN w ELSE upper(w[1]) || lower(w[2:]) END), ' ') AS title FROM s""",
    "source_label": """WITH u AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN 'C:\\docs\\' || regexp_replace(url, '[^a-z.]+', '_', 'g') || '//' ELSE '/srv/' || replace(url, '://', '/') END AS p FROM pages)
SELECT page_id, CASE WHEN contains(p, '://') OR regexp_extract(rtrim(replace(p, '\\', '/'), '/'), '[^/]*$') = '' THEN p ELSE regexp_extract(rtrim(replace(p, '\\', '/'), '/'), '[^/]*$') END AS label FROM u""",
    "retrieval_tokens": f"WITH {EXCHANGES} SELECT conv_id, turn, array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(question), '[^a-z0-9-]', ' ', 'g'), ' +'), lambda y: length(y) > 1), ' ') AS tokens, array_to_string({query_units('question')}, ' ') AS units FROM x",
    "postings_df": f"WITH {SECTIONS},{TOKENS}, p AS (SELECT term, doc_id, sec_idx, count(*) AS tf FROM tok GROUP BY ALL) SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM p GROUP BY term",
    "postings": f"WITH {SECTIONS},{TOKENS} SELECT doc_id, sec_idx, CAST(col AS INTEGER) AS col, count(DISTINCT term) AS n_terms, count(*) AS n_tokens, CAST(sum(pos) AS BIGINT) AS sum_positions FROM tok GROUP BY ALL",
    "bm25_topk": f"WITH {bm25(ASKED, 'corpus')}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, doc_id, sec_idx) - 1 AS rank FROM sco) SELECT CAST(qid AS BIGINT) AS qid, doc_id, sec_idx, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM r WHERE rank < 24",
    "bm25_document": f"WITH {bm25(ASKED, 'document')}, r AS (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY round(score, 12) DESC, sec_idx) - 1 AS rank FROM sco) SELECT CAST(qid AS BIGINT) AS qid, doc_id, sec_idx, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM r WHERE rank < 8",
    "dense_topk": """WITH v AS (SELECT label AS doc_id, CAST(vec_id AS INTEGER) AS sec_idx, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
q AS (SELECT doc_id, arg_min(e, sec_idx) AS q FROM v GROUP BY doc_id), s AS (SELECT v.doc_id, sec_idx, round(list_dot_product(q, e), 9) AS score FROM v JOIN q ON v.doc_id = q.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, sec_idx) - 1 AS rank FROM s) SELECT CAST(doc_id AS BIGINT) AS qid, doc_id, sec_idx, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM r WHERE rank < 24""",
    "cosine_pairs": """WITH v AS (SELECT vec_id, list_transform(embedding[1:40], lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)
SELECT a.vec_id, round(CASE WHEN list_dot_product(a.e, a.e) = 0 OR list_dot_product(b.e, b.e) = 0 THEN 0 ELSE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) END, 6) AS cosine FROM v a JOIN v b ON b.vec_id = a.vec_id + 1""",
    "semantic_edges": """WITH v AS (SELECT label AS doc_id, CAST(vec_id AS INTEGER) AS i, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE label IN (SELECT label FROM embeddings GROUP BY label HAVING count(*) <= 1000))
SELECT a.doc_id, a.i AS from_idx, b.i AS to_idx, round(list_dot_product(a.e, b.e), 6) AS weight FROM v a JOIN v b ON a.doc_id = b.doc_id AND a.i <> b.i WHERE list_dot_product(a.e, b.e) >= 0.3""",
    "structural_edges": f"WITH RECURSIVE {TREE},{EDGES} SELECT * FROM edge",
    "rrf_fuse": f"WITH {LISTS}, u AS (SELECT qid, sec_idx, CAST(2 AS DOUBLE) / (rank + 61) AS s FROM ra WHERE rank < 24 UNION ALL SELECT qid, sec_idx, CAST(1.5 AS DOUBLE) / (rank + 61) FROM rb WHERE rank < 24) SELECT qid, sec_idx, round(sum(s), 9) AS score FROM u GROUP BY qid, sec_idx",
    "graph_expand": f"WITH RECURSIVE {TREE},{EDGES}, ra AS (SELECT doc_id AS qid, sec_idx, row_number() OVER (PARTITION BY doc_id ORDER BY length(text) DESC, sec_idx) - 1 AS rank FROM sec), f AS (SELECT qid, sec_idx, CAST(2 AS DOUBLE) / (rank + 61) AS s FROM ra WHERE rank < 3), u AS (SELECT * FROM f UNION ALL SELECT qid, to_idx, {ALPHA} * weight * s FROM f JOIN edge ON qid = doc_id AND sec_idx = from_idx WHERE edge_type <> 'parent') SELECT qid, sec_idx, round(sum(s), 9) AS score FROM u GROUP BY qid, sec_idx",
    "hybrid_topk": hybrid(False),
    "stemmed_hybrid": hybrid(True),
    "query_confidence": f"WITH {EXCHANGES} SELECT conv_id, turn, round({confidence('question', 'answer')}, 6) AS confidence FROM x",
    "extractive_answer": f"WITH {EXCHANGES},{extractive('x', 'conv_id, turn')} SELECT x.conv_id, x.turn, coalesce(extract, '') AS extract FROM x LEFT JOIN ext ON x.conv_id = ext.conv_id AND x.turn = ext.turn",
    "key_number_match": f"WITH {NUMBERS},{PART_ASKED},{MATCHED} SELECT qid, label, value, unit FROM mat",
    "layer_route": f"""WITH {NUMBERS},{PART_ASKED},{MATCHED},
tx AS (SELECT doc_id, string_agg(s, chr(10) ORDER BY line) AS answer FROM ln GROUP BY doc_id),
z AS (SELECT pq.qid, pq.question, tx.answer, {any_of('lower(pq.question)', words.COMPLEX_MARKERS)} AS cx, CASE WHEN {any_of('lower(question)', words.SUMMARY_MARKERS)} THEN summary WHEN {any_of('lower(question)', words.INSIGHT_MARKERS)} THEN CASE WHEN len(insights) > 0 THEN array_to_string(list_transform(insights, lambda i: '• ' || i), chr(10)) END
  WHEN NOT {any_of('lower(trim(question))', words.COMPLEX_MARKERS)} AND label IS NOT NULL THEN label || ': ' || value || CASE WHEN coalesce(unit, '') <> '' THEN ' ' || unit ELSE '' END || ' (source: §1)' END AS zero
  FROM pq LEFT JOIN mat ON pq.qid = mat.qid JOIN tx ON pq.qid = tx.doc_id),
y AS (SELECT *, {confidence('question', 'answer')} AS conf FROM z),{extractive('z', 'qid')}
SELECT y.qid, coalesce(zero, CASE WHEN conf >= 0.6 AND NOT {any_of('lower(trim(y.question))', words.COMPLEX_MARKERS)} THEN extract END, '') AS answer,
  CASE WHEN zero IS NULL AND conf >= 0.6 AND NOT {any_of('lower(trim(y.question))', words.COMPLEX_MARKERS)} AND extract IS NOT NULL THEN '§1' ELSE '' END AS citations,
  CAST(CASE WHEN zero IS NOT NULL THEN 0 WHEN conf >= 0.6 AND NOT {any_of('lower(trim(y.question))', words.COMPLEX_MARKERS)} AND extract IS NOT NULL THEN 1 ELSE -1 END AS INTEGER) AS layer_used,
  round(CASE WHEN zero IS NOT NULL THEN 1 WHEN conf >= 0.6 AND NOT {any_of('lower(trim(y.question))', words.COMPLEX_MARKERS)} AND extract IS NOT NULL THEN conf ELSE 0 END, 6) AS confidence FROM y LEFT JOIN ext ON y.qid = ext.qid""",
    "answer_flags": f"""WITH {EXCHANGES}, y AS (SELECT conv_id, turn, trim(lower(CASE WHEN turn % 4 = 0 THEN 'List all ' ELSE '' END || question)) AS q, CASE conv_id % 3 WHEN 0 THEN 'I''m sorry: ' || answer WHEN 1 THEN '  ' ELSE answer END AS a FROM x)
SELECT conv_id, turn, {any_of('q', words.COMPLEX_MARKERS)} AS complex, regexp_full_match(a, '[ \\t\\n\\x0B\\f\\r]*') OR {any_of('lower(a[1:160])', words.REFUSAL_MARKERS)} AS refusal, {any_of('q', words.ENUMERATION_MARKERS)} AS enumeration FROM y""",
    "quantize_int8": f"WITH {INT8} SELECT vec_id, array_to_string(q, ' ') AS codes, round(list_sum(list_transform(q, lambda x: CAST(CAST(x / CAST(127 AS DOUBLE) AS FLOAT) AS DOUBLE))), 6) + 0 AS sum_back FROM c",
    "quantize_binary": """WITH b AS (SELECT vec_id, rpad(array_to_string(list_transform(embedding[1:61], lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), ''), 64, '0') AS s FROM embeddings)
SELECT vec_id, array_to_string(list_transform(range(16), lambda i: printf('%x', list_position(['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'], substr(s, i * 4 + 1, 4)) - 1)), '') AS bits, CAST(8 AS INTEGER) AS stride FROM b""",
    "normalized_vectors": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), n AS (SELECT vec_id, list_transform(e, lambda x: CAST(CAST(CASE WHEN sqrt(list_dot_product(e, e)) <= 1e-12 THEN x ELSE x / sqrt(list_dot_product(e, e)) END AS FLOAT) AS DOUBLE)) AS n FROM v)
SELECT vec_id, round(list_dot_product(n, n), 5) AS norm, round(n[1], 5) AS first FROM n""",
    "doc_fingerprint": f"""WITH RECURSIVE {TREE}, h AS (SELECT doc_id, count(*) AS n_sections, string_agg(hex(encode(id)) || lpad(hex(length(text) + length(regexp_replace(text, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g'))), 8, '0') || hex(encode(text[1:200])), '' ORDER BY sec_idx) AS h FROM tree GROUP BY doc_id)
SELECT doc_id, n_sections, sha256(unhex(hex(encode(CAST(doc_id AS VARCHAR))) || lpad(hex(n_sections), 8, '0') || h)) AS fingerprint FROM h""",
    "stale_documents": f"WITH {SECTIONS}, n AS (SELECT doc_id, count(*) AS n_sections FROM sec GROUP BY doc_id) SELECT doc_id, n_sections FROM n WHERE doc_id % 3 = 0 OR n_sections % 2 <> 0",
    "markdown_sections": """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), m AS (SELECT doc_id, i, CASE WHEN i % 5 = 1 THEN repeat('#', i % 3 + 1) || ' ' || ls[i + 1] WHEN i % 7 = 3 THEN '```' ELSE ls[i + 1] END AS s FROM (SELECT *, unnest(range(len(ls))) AS i FROM l)),
f AS (SELECT *, regexp_matches(s, '^[ \\t]*(```|~~~)') AS fe, sum(CASE WHEN regexp_matches(s, '^[ \\t]*(```|~~~)') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM m),
h AS (SELECT *, NOT fe AND k % 2 = 0 AND regexp_matches(s, '^#{1,6}\\s+.+?\\s*$') AS head FROM f), g AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS sec FROM h),
b AS (SELECT doc_id, sec, trim(coalesce(string_agg(s, chr(10) ORDER BY i) FILTER (WHERE NOT head), ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text, max(CASE WHEN head THEN regexp_extract(s, '^(#{1,6})\\s+(.+?)\\s*$', 2) END) AS title, max(CASE WHEN head THEN length(regexp_extract(s, '^(#{1,6})', 1)) END) AS level FROM g GROUP BY doc_id, sec),
d AS (SELECT *, max(sec) OVER (PARTITION BY doc_id) AS heads FROM b), e AS (SELECT * FROM d WHERE sec > 0 OR text <> '' OR heads = 0)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sec) - 1 AS INTEGER) AS sec_idx, coalesce(title, CASE WHEN heads = 0 THEN 'Doc ' ELSE 'Before ' END || doc_id) AS title, CAST(coalesce(level, 1) AS INTEGER) AS level, text FROM e""",
    "pdf_headings": f"""WITH {SECTIONS}, p AS (SELECT doc_id, sec_idx AS n, text, CASE WHEN sec_idx % 6 = 0 THEN 16.0 WHEN sec_idx % 6 = 3 THEN 13.0 WHEN length(text) % 7 = 0 THEN 11.8 ELSE 11.0 END::DOUBLE AS size, length(text) % 2 = 0 AS bold FROM sec),
m AS (SELECT doc_id, list_sort(list(size))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS med FROM p GROUP BY doc_id), h AS (SELECT p.*, size >= med * CAST(1.15 AS DOUBLE) AS large, (bold AND size >= med * CAST(1.05 AS DOUBLE) AND length(text) < 100) AS b FROM p JOIN m ON p.doc_id = m.doc_id WHERE text <> ''),
z AS (SELECT doc_id, size, least(row_number() OVER (PARTITION BY doc_id ORDER BY size DESC), 6) AS lv FROM (SELECT DISTINCT doc_id, size FROM h WHERE large)), k AS (SELECT h.*, coalesce(lv, 1) AS lv FROM h LEFT JOIN z ON h.doc_id = z.doc_id AND h.size = z.size AND large),
s AS (SELECT *, sum(CASE WHEN large OR b THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS sec FROM k),
g AS (SELECT doc_id, sec, max(CASE WHEN large OR b THEN text END) AS title, max(CASE WHEN large OR b THEN lv END) AS level, trim(coalesce(string_agg(text, chr(10) ORDER BY n) FILTER (WHERE NOT (large OR b)), ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text FROM s GROUP BY doc_id, sec)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sec) - 1 AS INTEGER) AS sec_idx, coalesce(title, 'Introduction') AS title, CAST(coalesce(level, 1) AS INTEGER) AS level, text FROM g""",
    "phase_rollup": "WITH s AS (SELECT lang AS phase, source AS file, quality * 7 + toxic * 2 AS score FROM labels JOIN documents USING (doc_id)) SELECT phase, file, count(*) AS n, round(avg(score), 6) AS avg_score, round(avg(CASE WHEN score >= 7 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate FROM s GROUP BY ROLLUP (phase, file)",
    "local_judge": f"""WITH {JUDGED} SELECT conv_id, turn, round(num_ratio, 6) AS num_ratio, round(kw_ratio, 6) AS kw_ratio, round(phrase_ratio, 6) AS phrase_ratio,
CAST(CASE WHEN c = '' OR c LIKE 'not found in context%' OR c LIKE 'not found in the context%' THEN 0 WHEN num_ratio >= 0.75 AND kw_ratio >= 0.45 THEN 10 WHEN n_rn = 0 AND kw_ratio >= 0.6 THEN 10 WHEN n_rn = 0 AND kw_ratio >= 0.4 THEN 9
WHEN b >= 0.7 THEN 10 WHEN b >= 0.55 THEN 9 WHEN b >= 0.4 THEN 8 WHEN b >= 0.28 THEN 7 WHEN b >= 0.18 THEN 6 WHEN b >= 0.1 THEN 5 WHEN b >= 0.04 THEN 3 ELSE 0 END AS INTEGER) AS score FROM j4""",
    "archive_roundtrip": f"WITH RECURSIVE {TREE},{KEYWORD_PARTS}, c AS (SELECT doc_id, parent_idx AS sec_idx, string_agg(id, ' ' ORDER BY sec_idx) AS ids FROM tree WHERE parent_idx IS NOT NULL GROUP BY doc_id, parent_idx) SELECT CAST(t.doc_id AS VARCHAR) AS doc_id, t.sec_idx, id, title, level, text, parent_id, coalesce(ids, '') AS children, coalesce(keywords, '') AS keywords, CAST(floor({word_count('text')} * CAST(1.3 AS DOUBLE)) AS INTEGER) AS token_count FROM tree t LEFT JOIN c ON t.doc_id = c.doc_id AND t.sec_idx = c.sec_idx LEFT JOIN k ON t.doc_id = k.doc_id AND t.sec_idx = k.sec_idx",
    "verdict_parse": "SELECT doc_id, CAST(CASE WHEN doc_id % 5 = 0 THEN 5 ELSE quality * 8 + toxic END AS INTEGER) AS score, CASE WHEN doc_id % 5 = 0 THEN 'parse error' ELSE 'because: yes' END AS reason FROM labels",
    "porter_bm25": f"WITH {bm25(ASKED, 'corpus', True)}, {RANKED}",
    "stored_index_topk": f"WITH {bm25(ASKED, 'corpus', True, NEW_SECTIONS)}, {RANKED}",
    "stored_index_stats": f"WITH RECURSIVE {TREE},{EDGES}, e AS (SELECT doc_id, count(*) AS n FROM edge GROUP BY doc_id), s AS (SELECT doc_id, count(*) AS n FROM sec GROUP BY doc_id) SELECT s.doc_id, s.n AS n_sections, coalesce(e.n, 0) AS n_edges FROM s LEFT JOIN e ON s.doc_id = e.doc_id WHERE s.doc_id % 7 <> 0",
    "rerank_topk": f"""WITH {LISTS}, h AS (SELECT qid, ra.sec_idx, rank, -CAST(abs(length(q.text) - length(sec.text)) AS DOUBLE) AS ce, count(*) OVER (PARTITION BY qid) AS many, CAST(length(sec.text) AS DOUBLE) AS own
  FROM ra JOIN sec ON qid = sec.doc_id AND ra.sec_idx = sec.sec_idx JOIN sec q ON q.doc_id = qid AND q.sec_idx = 1 WHERE rank < 12),
s AS (SELECT qid, sec_idx, rank, CASE WHEN many > 1 THEN ce ELSE own END AS score FROM h), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rank) - 1 AS n FROM s) SELECT qid, sec_idx, CAST(n AS INTEGER) AS rank, score FROM r WHERE n < 8""",
    "embedded_sections": f"""WITH {SECTIONS}, c AS (SELECT doc_id, sec_idx, title || ' ' || text AS t FROM sec), v AS (SELECT doc_id, sec_idx, CAST(length(t) AS DOUBLE) AS x, CAST(length(t) - length(replace(t, ' ', '')) AS DOUBLE) AS y, CAST(length(t) - length(replace(t, 'a', '')) AS DOUBLE) AS z FROM c)
SELECT doc_id, sec_idx, {', '.join(f"round(CAST(CAST({a} / sqrt(x * x + y * y + z * z) AS FLOAT) AS DOUBLE), 5) AS {a}" for a in 'xyz')} FROM v""",
    "key_numbers_kept": f"WITH {NUMBERS} SELECT doc_id, kn_idx, '§1' AS section, label, value, unit FROM kns WHERE kn_idx < 64 AND doc_id NOT IN (SELECT p_partkey FROM part WHERE p_size % 2 = 0) UNION ALL SELECT p_partkey, CAST(0 AS INTEGER), '§1', 'Size', CAST(p_size AS VARCHAR), NULL FROM part WHERE p_size % 2 = 0",
    "layered_answers": LAYERED,
    "model_judge": f"WITH {JUDGED}, n AS (SELECT conv_id, turn, {len(judge.PROMPT.format(question='', reference='', candidate=''))} + length('turn ' || turn) + length(candidate) + length(reference) AS n FROM j0) SELECT conv_id, turn, CAST(n % 11 AS INTEGER) AS score, 'length ' || n AS reason FROM n",
    "archive_vectors": f"""WITH {INT8}, h AS (SELECT label, vec_id, len(q) AS d, array_to_string(list_transform(q, lambda x: printf('%02X', (x + 256) % 256)), '') AS h FROM c JOIN embeddings USING (vec_id))
SELECT CAST(label AS VARCHAR) AS path, CAST(sum(d) AS BIGINT) AS n_bytes, md5(string_agg(h, '' ORDER BY vec_id)) AS md5, CAST(max(d) AS INTEGER) AS dims, 'int8' AS quantization, CAST(count(*) AS INTEGER) AS n_sections FROM h GROUP BY label""",
    "archive_info": f"WITH {NUMBERS}, k AS (SELECT doc_id, count(*) AS n FROM kns WHERE kn_idx < 64 GROUP BY doc_id) SELECT CAST(p_partkey AS VARCHAR) AS path, p_name AS title, 'txt' AS format, '1.0' AS version, CAST(1 AS INTEGER) AS n_sections, CAST(coalesce(n, 0) AS INTEGER) AS n_key_numbers, CASE WHEN p_size > 25 THEN 'About ' || p_name ELSE '' END AS summary FROM part LEFT JOIN k ON doc_id = p_partkey",
    "quantize_float16": """WITH x AS (SELECT vec_id, i, CAST(embedding[i] AS DOUBLE) AS x FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)),
e AS (SELECT *, CASE WHEN x = 0 THEN -14 ELSE greatest(CAST(floor(log2(abs(x))) AS INTEGER), -14) END AS e FROM x), q AS (SELECT *, round_even(abs(x) / pow(2, e - 10), 0) AS q FROM e),
b AS (SELECT vec_id, i, CAST((e + 14) * 1024 + q AS INTEGER) + CASE WHEN x < 0 THEN 32768 ELSE 0 END AS bits, q * pow(2, e - 10) * CASE WHEN x < 0 THEN -1 ELSE 1 END AS back FROM q)
SELECT vec_id, string_agg(printf('%02X%02X', bits % 256, bits // 256), '' ORDER BY i) AS bytes, round(list_sum(list(back ORDER BY i)), 6) + 0 AS sum_back FROM b GROUP BY vec_id""",
    "wordpiece_encode": WORDPIECES,
    "html_sections": f"""WITH a AS (SELECT page_id, regexp_extract(html, '(?s)<h1>(.*?)</h1>(.*?)</article>', 1) AS h, regexp_extract(html, '(?s)<h1>(.*?)</h1>(.*?)</article>', 2) AS body FROM pages WHERE html LIKE '%<h1>%'),
p AS (SELECT page_id, h, list_filter(list_transform(string_split(regexp_replace(body, '</p>', '<p>', 'g'), '<p>'), lambda x: trim(regexp_replace(x, '<[^>]*>', '', 'g'), ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '') AS ps FROM a)
SELECT page_id, CAST(0 AS INTEGER) AS sec_idx, trim({files.unescaped('h')}) AS title, CAST(1 AS INTEGER) AS level, {files.unescaped("array_to_string(ps, ' ')")} AS text FROM p""",
} | files.ORACLES
