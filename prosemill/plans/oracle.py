"""DuckDB SQL for the registered queries, built from one chain of common table expressions."""

from __future__ import annotations

from prosemill.functions import lexicons as L
from prosemill.operators.measures import METRICS
from prosemill.operators.resolve import RANKS
from prosemill.plans import planted, reports

SPACES = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
WORD = "[A-Za-zÀ-ÖØ-öø-ÿ]+(?:[''’-][A-Za-zÀ-ÖØ-öø-ÿ]+)*"
STANDALONE = (
    rf"^[{SPACES}]{{0,6}}(?:[-*+][{SPACES}]|[0-9]{{1,9}}[.)][{SPACES}]|>|#{{1,6}}[{SPACES}]|\||\[[ xX]\][{SPACES}])"
)


def words(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def syllables(word: str) -> str:
    plain = f"regexp_replace(lower({word}), '[^a-z]', '', 'g')"
    cut = f"regexp_replace(regexp_replace({plain}, '(?:[^laeiouy]es|[^taeiouyd]ed|[^laeiouy]e)$', ''), '^y', '')"
    groups = f"len(regexp_extract_all({cut}, '[aeiouy]+'))"
    return f"(CASE WHEN length({plain}) = 0 THEN 0 WHEN length({plain}) <= 3 THEN 1 ELSE greatest({groups}, 1) END)"


def round1(x: str) -> str:
    return f"(floor(({x}) * 10 + 0.5) / 10)"


def ly(word: str) -> str:
    return f"(length({word}) >= 4 AND {word} LIKE '%ly' AND {word} NOT IN {words(L.NOT_ADVERBS)})"


def lexical(weasel: bool, hedge: bool) -> str:
    cases = ""
    if weasel:
        cases += f" WHEN lower IN {words(L.WEASELS)} THEN 'weasel'"
    if hedge:
        cases += f" WHEN lower IN {words(L.HEDGES)} THEN 'hedge'"
    return f"CASE{cases} WHEN {ly('lower')} THEN 'adverb' END"


def chain(base: str, p: str = "") -> str:
    """Common table expressions p-docs, p-sentences, p-tokens and the marks over ``base`` (doc_id, text)."""
    near = r"regexp_matches(gap, '^[ \t\n\r]{0,8}$')"
    fold = "translate(lower, '’‘', '''''')"
    leads = ", ".join(f"lead(w, {i}) OVER o AS w{i}, lead(near, {i}) OVER o AS near{i}, lead(stop, {i}) OVER o AS stop{i}" for i in range(1, 6))

    def participle(i: int) -> str:
        return (
            f"coalesce(w{i} IN {words(L.IRREGULAR_PARTICIPLES)} OR (length(w{i}) >= 4 AND w{i} LIKE '%ed' "
            f"AND w{i} NOT IN {words(L.NOT_PARTICIPLES)} AND w{i} NOT IN {words(L.NOT_ADVERBS)}), false)"
        )

    def verb(i: int) -> str:
        agent = f"coalesce(near{i + 1} AND w{i + 1} = 'by' AND near{i + 2} AND w{i + 2} NOT IN {words(L.NOT_AGENTS)}, false)"
        return f"(w{i} NOT IN {words(L.ED_ADJECTIVES)} OR {agent})"

    def step(i: int) -> str:
        return f"coalesce(w{i} IN {words(L.BETWEEN)} OR {ly(f'w{i}')}, false)"

    reach = ["coalesce(near1, false)"]
    for i in (2, 3):
        reach.append(f"{reach[-1]} AND NOT {participle(i - 1)} AND {step(i - 1)} AND coalesce(near{i}, false)")
    hit = " ".join(f"WHEN {reach[i - 1]} AND {participle(i)} AND {verb(i)} THEN {i}" for i in (1, 2, 3))
    ranks = " ".join(f"WHEN '{r}' THEN {n}" for r, n in RANKS.items())
    return f"""
{p}docs AS (SELECT doc_id, coalesce(text, '') AS text FROM ({base})),
{p}split_lines AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM {p}docs),
{p}lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM {p}split_lines),
{p}flags AS (
  SELECT doc_id, n, line, (sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n) - length(line) - 1)::INT AS start,
    NOT regexp_matches(line, '[^{SPACES}]') AS blank, regexp_matches(line, '{STANDALONE}') AS alone FROM {p}lines),
{p}starts AS (
  SELECT *, NOT blank AND NOT (NOT alone AND NOT lag(blank, 1, true) OVER o AND NOT lag(alone, 1, true) OVER o) AS opens
  FROM {p}flags WINDOW o AS (PARTITION BY doc_id ORDER BY n)),
{p}numbered AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY n) AS block FROM {p}starts),
{p}blocks AS (
  SELECT doc_id, block, min(start) AS start, string_agg(line, ' ' ORDER BY n) AS chunk FROM {p}numbered WHERE NOT blank GROUP BY ALL),
{p}split_blocks AS (
  SELECT doc_id, block, start,
    string_split(regexp_replace(chunk, '([.!?])([{SPACES}])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS ps FROM {p}blocks),
{p}pieces AS (SELECT doc_id, block, start, unnest(ps) AS piece, generate_subscripts(ps, 1) AS n FROM {p}split_blocks),
{p}placed AS (
  SELECT doc_id, (start + sum(length(piece)) OVER (PARTITION BY doc_id, block ORDER BY n) - length(piece))::INT AS pos, piece,
    regexp_replace(piece, '^[{SPACES}]+', '') AS ltrimmed FROM {p}pieces),
{p}trimmed AS (
  SELECT doc_id, (pos + length(piece) - length(ltrimmed))::INT AS start, regexp_replace(ltrimmed, '[{SPACES}]+$', '') AS text
  FROM {p}placed WHERE ltrimmed <> ''),
{p}plain_sentences AS (
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1)::INT AS sent_idx, start, (start + length(text))::INT AS stop, text
  FROM {p}trimmed),
{p}split_sentences AS (
  SELECT doc_id, sent_idx, start, regexp_split_to_array(text, '{WORD}') AS gs, regexp_extract_all(text, '{WORD}') AS ws
  FROM {p}plain_sentences),
{p}pairs AS (
  SELECT doc_id, sent_idx, start, unnest(ws) AS token, unnest(gs[:len(ws)]) AS gap, generate_subscripts(ws, 1) - 1 AS tok
  FROM {p}split_sentences WHERE len(ws) > 0),
{p}ended AS (
  SELECT *, (start + sum(length(gap) + length(token)) OVER (PARTITION BY doc_id, sent_idx ORDER BY tok))::INT AS stop FROM {p}pairs),
{p}tokens AS (
  SELECT doc_id, sent_idx, tok, (stop - length(token))::INT AS start, stop, token, lower(token) AS lower, gap FROM {p}ended),
{p}sentences AS (
  SELECT s.doc_id, s.sent_idx, s.start, s.stop, coalesce(t.words, 0)::INT AS words, coalesce(t.syllables, 0)::INT AS syllables
  FROM {p}plain_sentences s LEFT JOIN (
    SELECT doc_id, sent_idx, count(*) AS words, sum({syllables("token")}) AS syllables FROM {p}tokens GROUP BY ALL) t
  USING (doc_id, sent_idx)),
{p}sums AS (
  SELECT doc_id, sum(words) AS w, count(*) AS n, sum(syllables) AS syl, max(words) AS longest FROM {p}sentences GROUP BY doc_id),
{p}readability AS (
  SELECT doc_id, (CASE WHEN w > 0 THEN w ELSE 0 END)::BIGINT AS words, (CASE WHEN w > 0 THEN n ELSE 0 END)::BIGINT AS sentences,
    (CASE WHEN w > 0 THEN syl ELSE 0 END)::BIGINT AS syllables,
    CASE WHEN w > 0 THEN {round1("greatest(0.0, least(100.0, 206.835::DOUBLE - 1.015::DOUBLE * (w::DOUBLE / n) - 84.6::DOUBLE * (syl::DOUBLE / w)))")} ELSE 0.0 END AS flesch,
    CASE WHEN w > 0 THEN {round1("greatest(0.0, 0.39::DOUBLE * (w::DOUBLE / n) + 11.8::DOUBLE * (syl::DOUBLE / w) - 15.59::DOUBLE)")} ELSE 0.0 END AS grade,
    CASE WHEN w > 0 THEN {round1("w::DOUBLE / n")} ELSE 0.0 END AS "avgSentenceWords",
    (CASE WHEN w > 0 THEN longest ELSE 0 END)::BIGINT AS "longestSentenceWords"
  FROM {p}docs LEFT JOIN {p}sums USING (doc_id)),
{p}labelled AS (
  SELECT *, CASE WHEN flesch >= 80 THEN 'Very easy' WHEN flesch >= 60 THEN 'Easy' WHEN flesch >= 50 THEN 'Fairly hard'
    WHEN flesch >= 30 THEN 'Hard' ELSE 'Very hard' END AS ease FROM {p}readability),
{p}lexical AS (
  SELECT * FROM (SELECT doc_id, start, stop, {lexical(True, True)} AS rule, 'info' AS severity, lower AS word FROM {p}tokens) WHERE rule IS NOT NULL),
{p}unhedged AS (
  SELECT * FROM (SELECT doc_id, start, stop, {lexical(True, False)} AS rule, 'info' AS severity, lower AS word FROM {p}tokens) WHERE rule IS NOT NULL),
{p}lagged AS (
  SELECT *, lag(lower) OVER o AS before, lag(start) OVER o AS first FROM {p}tokens WINDOW o AS (PARTITION BY doc_id, sent_idx ORDER BY tok)),
{p}doubled AS (
  SELECT doc_id, first AS start, stop, 'doubled' AS rule, 'warn' AS severity, lower AS word FROM {p}lagged
  WHERE before = lower AND regexp_matches(gap, '^[{SPACES}]*$')),
{p}heads AS (
  SELECT doc_id, sent_idx, tok, start, stop, lower, {fold} AS w, {near} AS near FROM {p}tokens),
{p}ahead AS (
  SELECT *, lag(lower) OVER o AS before, {leads} FROM {p}heads WINDOW o AS (PARTITION BY doc_id, sent_idx ORDER BY tok)),
{p}hits AS (
  SELECT *, CASE {hit} END AS hit FROM {p}ahead WHERE w IN {words([*L.BE_FORMS, *L.GET_FORMS])}),
{p}passive_all AS (
  SELECT doc_id, sent_idx, tok, tok + hit AS last, start, CASE hit WHEN 1 THEN stop1 WHEN 2 THEN stop2 ELSE stop3 END AS stop,
    coalesce(before IN {words(L.MODALS)}, false) AS modal, row_number() OVER (PARTITION BY doc_id, sent_idx ORDER BY tok) AS rn
  FROM {p}hits WHERE hit IS NOT NULL),
{p}passive_kept AS (
  SELECT doc_id, sent_idx, rn, start, stop, modal, last AS upto, true AS kept FROM {p}passive_all WHERE rn = 1
  UNION ALL
  SELECT c.doc_id, c.sent_idx, c.rn, c.start, c.stop, c.modal, CASE WHEN c.tok > k.upto THEN c.last ELSE k.upto END, c.tok > k.upto
  FROM {p}passive_kept k JOIN {p}passive_all c ON c.doc_id = k.doc_id AND c.sent_idx = k.sent_idx AND c.rn = k.rn + 1),
{p}passive AS (
  SELECT doc_id, start, stop, 'passive' AS rule, CASE WHEN modal THEN 'info' ELSE 'warn' END AS severity, NULL::VARCHAR AS word
  FROM {p}passive_kept WHERE kept),
{p}long AS (
  SELECT doc_id, start, stop, 'longSentence' AS rule, CASE WHEN words >= 40 THEN 'strong' ELSE 'warn' END AS severity, NULL::VARCHAR AS word
  FROM {p}sentences WHERE words >= 25),
{p}candidates AS (
  SELECT * FROM {p}unhedged UNION ALL SELECT * FROM {p}doubled UNION ALL SELECT * FROM {p}passive UNION ALL SELECT * FROM {p}long),
{p}marks AS (
  SELECT doc_id, start, stop, rule, severity, word FROM (
    SELECT *, max(stop) OVER (PARTITION BY doc_id, rule IN ('doubled', 'longSentence')
      ORDER BY start, stop DESC, CASE rule {ranks} ELSE 0 END DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {p}candidates)
  WHERE rule IN ('doubled', 'longSentence') OR reach IS NULL OR stop > reach),
{p}counts AS (SELECT doc_id, rule, count(*) AS n FROM {p}marks GROUP BY ALL)"""


DOCUMENTS = "WITH RECURSIVE" + chain("SELECT doc_id, text FROM documents")
SPAN = "SELECT doc_id, start, stop, rule, severity, word FROM "
BAND = "CASE WHEN words <= 8 THEN 'short' WHEN words >= 40 THEN 'veryLong' WHEN words >= 25 THEN 'long' ELSE 'medium' END"
STOP = words(L.STOPWORDS)
BASE = "CASE WHEN instr(lower, '''') > 1 THEN substr(lower, 1, instr(lower, '''') - 1) WHEN instr(lower, '''') = 0 AND instr(lower, '’') > 1 THEN substr(lower, 1, instr(lower, '’') - 1) ELSE lower END"
ECHOES = f"""{DOCUMENTS},
words_seen AS (SELECT *, lower IN {STOP} OR {BASE} IN {STOP} AS is_stop FROM tokens),
nexts AS (SELECT *, lead(lower) OVER o AS nxt, lead(is_stop) OVER o AS nxt_stop, lead(start) OVER o AS second
  FROM words_seen WINDOW o AS (PARTITION BY doc_id, sent_idx ORDER BY tok)),
terms AS (
  SELECT doc_id, 'word' AS kind, lower AS term, sent_idx, start, NULL::INT AS second FROM nexts WHERE NOT is_stop AND length(lower) >= 4
  UNION ALL
  SELECT doc_id, 'phrase', lower || ' ' || nxt, sent_idx, start, second FROM nexts WHERE nxt IS NOT NULL AND NOT (is_stop AND nxt_stop)),
per_sentence AS (SELECT doc_id, kind, term, sent_idx, count(*) AS n FROM terms GROUP BY ALL),
near AS (SELECT doc_id, kind, term, sum(n) OVER (PARTITION BY doc_id, kind, term ORDER BY sent_idx RANGE BETWEEN 3 PRECEDING AND CURRENT ROW) AS w FROM per_sentence),
qualified AS (SELECT doc_id, kind, term FROM near GROUP BY ALL HAVING max(w) >= 3),
found AS (SELECT doc_id, kind, term, count(*) AS n, list(start ORDER BY start) AS a, list(second ORDER BY second) AS b
  FROM terms JOIN qualified USING (doc_id, kind, term) GROUP BY ALL),
names AS (SELECT doc_id, lower AS term FROM tokens WHERE tok > 0 GROUP BY ALL HAVING bool_and(substr(token, 1, 1) <> substr(lower, 1, 1))),
heard AS (SELECT * FROM found WHERE kind = 'word'),
kept AS (
  SELECT f.* FROM found f
  WHERE NOT EXISTS (SELECT 1 FROM names x WHERE x.doc_id = f.doc_id AND x.term = split_part(f.term, ' ', 1))
    AND NOT EXISTS (SELECT 1 FROM names x WHERE x.doc_id = f.doc_id AND x.term = split_part(f.term, ' ', -1))
    AND (f.kind = 'word' OR (
      NOT EXISTS (SELECT 1 FROM heard x WHERE x.doc_id = f.doc_id AND x.term = split_part(f.term, ' ', 1) AND x.a = f.a)
      AND NOT EXISTS (SELECT 1 FROM heard x WHERE x.doc_id = f.doc_id AND x.term = split_part(f.term, ' ', -1) AND x.a = f.b)))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term) AS r FROM kept)
SELECT doc_id, term, kind, n AS "count", array_to_string(a, ',') AS offsets FROM ranked WHERE r <= 25"""


def _delta() -> str:
    sides = {
        "b": "SELECT conv_id AS doc_id, arg_min(text, turn) AS text FROM conversations GROUP BY conv_id",
        "a": "SELECT conv_id AS doc_id, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id",
    }
    ctes, flat = [], ("words", "grade", "flesch", "avgSentenceWords")
    for p, base in sides.items():
        ctes.append(chain(base, f"{p}_"))
        metrics = " UNION ALL ".join(
            f"SELECT doc_id, '{k}' AS key, \"{k}\"::DOUBLE AS v FROM {p}_readability"
            if k in flat
            else f"SELECT d.doc_id, '{k}', coalesce(c.n, 0)::DOUBLE FROM {p}_docs d LEFT JOIN {p}_counts c ON c.doc_id = d.doc_id AND c.rule = '{k}'"
            for k, _, _ in METRICS
        )
        ctes.append(f"\n{p}_metrics AS ({metrics})")
    signs = ", ".join(f"('{k}', {sign})" for k, _, sign in METRICS)
    return (
        "WITH RECURSIVE" + ",".join(ctes) + f", signs(key, sign) AS (VALUES {signs}), moved AS ("
        f'SELECT b.doc_id, b.key, b.v AS "before", a.v AS "after", {round1("a.v - b.v")} + 0.0 AS delta, sign '
        "FROM b_metrics b JOIN a_metrics a USING (doc_id, key) JOIN signs USING (key)) "
        'SELECT doc_id, key, "before", "after", delta, CASE WHEN sign <> 0 AND delta <> 0 THEN sign(delta) = sign END AS better FROM moved'
    )


def _mark(beyond: str, order: str) -> str:
    return f"""{DOCUMENTS}, cursors AS (SELECT doc_id, (length(text) // 2)::INT AS cursor FROM documents WHERE text IS NOT NULL),
ranked AS (SELECT doc_id, cursor, l.start, l.stop, l.rule, row_number() OVER (
  PARTITION BY doc_id ORDER BY ({beyond}) DESC, l.start {order}, l.stop {order}, l.rule {order}) AS r
  FROM cursors JOIN lexical l USING (doc_id))
SELECT doc_id, cursor, start, stop, rule FROM ranked WHERE r = 1"""


def _passthrough(table: str) -> str:
    return f"{DOCUMENTS} {SPAN}{table}"


LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
MIDDLES = f"""SELECT doc_id, m AS cursor, CASE WHEN regexp_matches(w, '[{LETTERS}]') THEN w END AS word FROM (
  SELECT doc_id, m, regexp_replace(regexp_extract(substr(text, 1, m), '[{LETTERS}''’-]*$') || regexp_extract(substr(text, m + 1), '^[{LETTERS}''’-]*'),
    '^[-''’]+|[-''’]+$', '', 'g') AS w
  FROM (SELECT doc_id, text, (length(text) // 2)::INT AS m FROM documents WHERE text IS NOT NULL))"""
MONOTONE = f"""{DOCUMENTS},
lens AS (SELECT doc_id, list(words ORDER BY sent_idx) AS ls FROM sentences GROUP BY doc_id),
walk AS (
  SELECT doc_id, ls, 1 AS start, 1 AS pos, ls[1] AS lo, ls[1] AS hi, 0 AS found FROM lens
  UNION ALL
  SELECT doc_id, ls, CASE WHEN fits THEN start WHEN pos - start >= 3 THEN pos + 1 ELSE start + 1 END,
    CASE WHEN fits OR pos - start >= 3 THEN pos + 1 ELSE start + 1 END,
    CASE WHEN fits THEN least(lo, ls[pos + 1]) WHEN pos - start >= 3 THEN ls[pos + 1] ELSE ls[start + 1] END,
    CASE WHEN fits THEN greatest(hi, ls[pos + 1]) WHEN pos - start >= 3 THEN ls[pos + 1] ELSE ls[start + 1] END,
    CASE WHEN NOT fits AND pos - start >= 3 THEN pos - start + 1 ELSE 0 END
  FROM (SELECT *, pos < len(ls) AND greatest(hi, ls[pos + 1]) - least(lo, ls[pos + 1]) <= 3 AS fits FROM walk WHERE start <= len(ls)))
SELECT d.doc_id, coalesce(r.runs, 0)::INT AS runs, coalesce(r.total, 0)::INT AS "flatSentences"
FROM docs d LEFT JOIN (SELECT doc_id, count(*) AS runs, sum(found) AS total FROM walk WHERE found > 0 GROUP BY doc_id) r USING (doc_id)"""

REMAPPED = """WITH RECURSIVE edits AS (
  SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, event_id % 500 AS low, event_id % 500 + event_id % 5 AS high, event_id % 4 AS n FROM events),
walk AS (
  SELECT DISTINCT user_id, x AS "offset", x AS l, x AS r, 0::BIGINT AS k FROM events, range(0, 601, 60) t(x)
  UNION ALL
  SELECT w.user_id, "offset", CASE WHEN l <= low THEN l WHEN l < high THEN low ELSE l + n - (high - low) END,
    CASE WHEN r < low OR (r = low AND high > low) THEN r WHEN r < high THEN low + n ELSE r + n - (high - low) END, e.k
  FROM walk w JOIN edits e ON e.user_id = w.user_id AND e.k = w.k + 1)
SELECT user_id AS doc_id, "offset", l AS to_left, r AS to_right FROM walk w JOIN (SELECT user_id, max(k) AS most FROM edits GROUP BY user_id) m USING (user_id) WHERE k = most"""

ORACLE_SQL = {
    "remapped": REMAPPED,
    "sql_scores": f"""SELECT lang, source, count(*) AS words, sum({syllables('word')})::BIGINT AS syllables, max({syllables('word')})::INT AS most,
  CASE WHEN e >= 80 THEN 'Very easy' WHEN e >= 60 THEN 'Easy' ELSE 'other' END AS ease FROM (
  SELECT *, {round1("100 - 10 * (sum(" + syllables('word') + ") OVER (PARTITION BY lang, source))::DOUBLE / count(*) OVER (PARTITION BY lang, source)")} AS e
  FROM (SELECT lang, source, unnest(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS word FROM documents)) GROUP BY lang, source, e""",
    "sql_marks": f"""{DOCUMENTS} SELECT m.doc_id, rule, count(*) AS n, min(start) AS first, grade FROM marks m JOIN labelled s USING (doc_id)
WHERE rule IN ('adverb', 'passive') AND words > 100 GROUP BY m.doc_id, rule, grade""",
    **planted.ORACLE_SQL,
    **reports.oracle_sql(DOCUMENTS),
    "moved": f"SELECT doc_id, bool_or(delta <> 0) AS moved FROM ({_delta()}) GROUP BY doc_id",
    "changed_documents": "SELECT doc_id, sha256(coalesce(text, '')) AS text_hash FROM documents WHERE doc_id % 3 <> 0",
    "fifth_adverbs": f"""{DOCUMENTS}, own AS (SELECT doc_id, start, stop, row_number() OVER (PARTITION BY doc_id ORDER BY start, stop) - 1 AS place,
count(*) OVER (PARTITION BY doc_id) AS n FROM lexical WHERE rule = 'adverb') SELECT doc_id, start, stop FROM own WHERE place = 5 % n""",
    "words_at_middle": MIDDLES,
    "marks_at_middle": f"""{DOCUMENTS}, middles AS ({MIDDLES}) SELECT l.doc_id, cursor, start, stop, rule FROM middles m JOIN lexical l
ON l.doc_id = m.doc_id AND l.word = lower(m.word) WHERE cursor BETWEEN start AND stop""",
    "dimmed": f"""{DOCUMENTS}, cursors AS (SELECT doc_id, length(text) AS n, (length(text) // 2)::INT AS cursor FROM documents WHERE text IS NOT NULL),
here AS (SELECT doc_id, n, cursor, s.start, s.stop FROM cursors JOIN sentences s USING (doc_id) WHERE cursor BETWEEN s.start AND s.stop
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s.start, s.stop) = 1)
SELECT doc_id, cursor, concat_ws(',', CASE WHEN start > 0 THEN '0-' || start END, CASE WHEN stop < n THEN stop || '-' || n END) AS ranges FROM here""",
    "monotone_runs": MONOTONE,
    "word_counts": f"{DOCUMENTS} SELECT doc_id, count(*) AS words, count(DISTINCT lower) AS distinct_words FROM tokens GROUP BY doc_id",
    "syllable_totals": f"{DOCUMENTS} SELECT doc_id, sum({syllables('token')})::BIGINT AS syllables FROM tokens GROUP BY doc_id",
    "sentences": f"{DOCUMENTS} SELECT doc_id, sent_idx, start, stop, words, syllables FROM sentences",
    "readability": f"{DOCUMENTS} SELECT * FROM labelled",
    "ease_histogram": f"{DOCUMENTS} SELECT lang, ease, count(*) AS docs, sum(words)::BIGINT AS words FROM labelled JOIN documents USING (doc_id) GROUP BY lang, ease",
    "status_lines": f"{DOCUMENTS} SELECT doc_id, CASE WHEN words > 0 THEN printf('Grade %.1f · ', grade) || ease END AS status FROM labelled",
    "lexical_marks": _passthrough("lexical"),
    "adverb_marks": f"{DOCUMENTS} SELECT doc_id, start, stop, 'adverb' AS rule, 'info' AS severity, lower AS word FROM tokens WHERE {ly('lower')}",
    "doubled_words": _passthrough("doubled"),
    "passive_marks": _passthrough("passive"),
    "long_sentences": f"""{DOCUMENTS} SELECT doc_id, start, stop, 'longSentence' AS rule, CASE WHEN words >= 40 THEN 'strong' ELSE 'warn' END AS severity,
CASE WHEN words >= 40 THEN 'Very long sentence (' || words || ' words) — hard to read in one pass' ELSE 'Long sentence (' || words || ' words)' END AS message
FROM sentences WHERE words >= 25""",
    "relational_marks": _passthrough("marks"),
    "ignored_marks": _passthrough("lexical WHERE word NOT IN ('erly', 'thly', 'inly')"),
    "rule_counts": f"{DOCUMENTS} SELECT doc_id, rule, n FROM counts",
    "legend_counts": f"""{DOCUMENTS}, shown(rule) AS (VALUES ('adverb'), ('passive'), ('weasel'), ('doubled'), ('longSentence')),
grid AS (SELECT d.doc_id, s.rule, coalesce(c.n, 0) AS n FROM docs d CROSS JOIN shown s LEFT JOIN counts c ON c.doc_id = d.doc_id AND c.rule = s.rule)
SELECT doc_id, rule, n, (sum(n) OVER (PARTITION BY doc_id))::BIGINT AS total FROM grid""",
    "corpus_rollup": f"""{DOCUMENTS} SELECT lang, source, rule, sum(n)::BIGINT AS marks, count(DISTINCT doc_id) AS docs
FROM counts JOIN documents USING (doc_id) GROUP BY ROLLUP (lang, source, rule)""",
    "sentence_bands": f"""{DOCUMENTS} SELECT doc_id, sent_idx, words, {BAND} AS band,
greatest(4, floor(words::DOUBLE / greatest(max(words) OVER (PARTITION BY doc_id), 1) * 100 + 0.5))::INT AS bar_width FROM sentences""",
    "variety": f"""{DOCUMENTS} SELECT doc_id, CASE WHEN n >= 2 THEN {round1("sd")} ELSE 0.0 END AS variety
FROM docs LEFT JOIN (SELECT doc_id, count(*) AS n, stddev_pop(words) AS sd FROM sentences GROUP BY doc_id) USING (doc_id)""",
    "echoes": ECHOES,
    "revision_delta": _delta(),
    "next_mark": _mark("l.start > cursor", "ASC"),
    "previous_mark": _mark("l.start < cursor", "DESC"),
    "cursor_sentence": f"""{DOCUMENTS}, cursors AS (SELECT doc_id, (length(text) // 2)::INT AS cursor FROM documents WHERE text IS NOT NULL)
SELECT doc_id, cursor, s.start, s.stop, s.sent_idx FROM cursors JOIN sentences s USING (doc_id)
WHERE cursor BETWEEN s.start AND s.stop QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s.start, s.stop) = 1""",
    "guarded": """SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'muted' WHEN length(coalesce(text, '')) > 5000 THEN 'too-large' END AS reason,
CASE WHEN doc_id % 10 <> 0 AND length(coalesce(text, '')) > 5000 THEN length(text) END AS chars,
CASE WHEN doc_id % 10 = 0 THEN 'Marks are muted for this note.' WHEN length(coalesce(text, '')) > 5000 THEN
'This note is too large for live analysis (' || format('{:,}', length(text)) || ' characters, limit 5,000). Raise the limit in settings, under Performance.' END AS said
FROM documents""",
    "event_bursts": """WITH gaps AS (SELECT *, coalesce(ts - lag(ts) OVER o >= INTERVAL 10 MINUTES, true)::INT AS opens FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts)),
bursts AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS burst FROM gaps)
SELECT user_id AS doc_id, arg_max(event_id, (ts, event_id)) AS version, arg_max(event_type, (ts, event_id)) AS text, count(*) AS revisions
FROM bursts GROUP BY user_id, burst""",
}
