"""The same results as plain SQL, for an engine that shares nothing with Spark.

Written independently of the Spark expressions: words are bounded by explicit marks
instead of a boundary assertion, repeated characters are found by comparing each one
with its two predecessors, and medians, folds and samples use ordinary windows.
"""

from __future__ import annotations

from sentika.lexicons.sample import LANGUAGE_PROFILES, STOP_WORDS
from sentika.plans.sample_views import ASPECTS, LEXICON

# The character sets of the cleaning contract.
WORD = r"\p{L}\p{N}_"
SPACE = (
    r"\t-\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
EMOJI = (
    r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F9FF}"
    r"\x{2600}-\x{27BF}\x{1F1E0}-\x{1F1FF}\x{200D}\x{FE0F}]+"
)


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sub(text: str, pattern: str, new: str) -> str:
    return f"regexp_replace({text}, {q(pattern)}, {new if new.startswith('chr') else q(new)}, 'g')"


def space(text: str) -> str:
    return f"trim({sub(text, f'[{SPACE}]+', ' ')}, ' ')"


def html(text: str) -> str:
    return sub(text, "<[^>]+>", "")


def emoji(text: str) -> str:
    return sub(text, EMOJI, "")


def urls(text: str) -> str:
    return sub(text, rf"https?://[^{SPACE}]+|www\.[^{SPACE}]+", "")


def mentions(text: str) -> str:
    return sub(text, rf"[@#][{WORD}]+", "")


def repeats(text: str) -> str:
    """Drop a character equal to both predecessors, unless it is a line feed."""
    chars = f"string_split({text}, '')"
    triples = f"list_zip({chars}, list_prepend(NULL, {chars}), list_prepend(NULL, list_prepend(NULL, {chars})))"
    kept = f"list_filter({triples}, lambda z: z[1] IS NOT NULL AND NOT (z[1] <> chr(10) AND coalesce(z[1] = z[2] AND z[1] = z[3], false)))"
    return f"coalesce(array_to_string(list_transform({kept}, lambda z: z[1]), ''), '')"


def punctuation(text: str) -> str:
    return sub(text, r"([!?.]){2,}", r"\1")


def look_up(text: str, table: dict[str, str], key: str = "lower(w)") -> str:
    cases = " ".join(f"WHEN {q(k)} THEN {q(' '.join(v.split()))}" for k, v in table.items())
    words = f"regexp_split_to_array({text}, {q(f'[{SPACE}]+')})"
    replaced = f"list_transform({words}, lambda w: CASE {key} {cases} ELSE w END)"
    return f"coalesce(array_to_string(list_filter({replaced}, lambda w: w <> ''), ' '), '')"


def slang(text: str) -> str:
    return look_up(text, dict(LEXICON.slang))


def special(text: str) -> str:
    return sub(text, rf"[^{WORD}{SPACE}.,!?;:()\-']", " ")


def tokens(text: str) -> str:
    return f"regexp_extract_all(lower({text}), {q(f'[{WORD}]+')})"


def word_count(text: str) -> str:
    return f"CAST(len(list_filter(regexp_split_to_array({text}, {q(f'[{SPACE}]+')}), lambda w: w <> '')) AS INT)"


def sent_count(text: str) -> str:
    return f"CAST(len(regexp_extract_all({text}, '[.!?]+')) AS INT)"


def hits(text: str, terms) -> str:
    """Whole-word hits: every boundary is marked with a control character first."""
    marked = f"chr(1) || {sub(f'lower({text})', f'([^{WORD}])', 'chr(1) || ' + q(chr(92) + '1') + ' || chr(1)')} || chr(1)"
    listed = "|".join(t.replace(" ", r"\x01 \x01") for t in terms)
    return f"CAST(len(regexp_extract_all({marked}, {q(rf'\x01({listed})\x01')})) AS INT)"


def unit(seed: str, key: str) -> str:
    return f"(('0x' || substr(md5('{seed}:' || {key}), 1, 8))::BIGINT / 4294967296::DOUBLE)"


REVIEWS = """reviews AS (
  SELECT CAST(doc_id AS VARCHAR) AS review_id, doc_id, text AS review_text, lang, source,
         CASE WHEN doc_id % 17 <> 0 THEN CAST(1 + doc_id % 5 AS INT) END AS rating,
         TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * doc_id AS review_date
  FROM documents)"""


def chain(source: str, stems: bool = False, name: str = "chain_done") -> str:
    """The cleaning chain over ``source`` (review_text and any other columns)."""
    steps = [
        "nfc_normalize(coalesce(review_text, ''))",
        html("t"),
        emoji("t"),
        urls("t"),
        mentions("t"),
        repeats("t"),
        f"lower({punctuation('t')})",
        slang("t"),
        space(special("t")),
    ]
    if stems:
        steps.append(space(look_up("t", dict(LEXICON.stems))))
    ctes, previous = [], source
    for i, step in enumerate(steps):
        last = i == len(steps) - 1
        target = name if last else f"chain_{i}"
        column = "clean_text" if last else "t"
        shown = "*" if i == 0 else "* EXCLUDE (t)"
        ctes.append(f"{target} AS MATERIALIZED (SELECT {shown}, {step} AS {column} FROM {previous})")
        previous = target
    return ",\n".join(ctes)


CLEANED = f"""{REVIEWS},
{chain("reviews")},
cleaned AS (
  SELECT *, CAST(length(clean_text) AS INT) AS char_count, {word_count("clean_text")} AS word_count,
         {sent_count("clean_text")} AS sent_count FROM chain_done)"""

_HITS = ", ".join(f"{hits('clean_text', terms)} AS h{i}" for i, terms in enumerate(LEXICON.aspects.values()))
_FOUND = ", ".join(f"CASE WHEN h{i} > 0 THEN '{a}' END" for i, a in enumerate(ASPECTS))
BY_WORDS = "CASE WHEN p > n THEN 'Positif' WHEN n > p THEN 'Negatif' ELSE 'Netral' END"
BY_STARS = f"""CASE WHEN rating >= 4 THEN CASE WHEN p >= n THEN 'Positif' ELSE 'Netral' END
     WHEN rating <= 2 THEN CASE WHEN n >= p THEN 'Negatif' ELSE 'Netral' END
     ELSE {BY_WORDS} END"""


def labels_of(source: str, where: str) -> str:
    return f"""counted AS MATERIALIZED (
  SELECT *, {_HITS}, {hits("clean_text", LEXICON.positive)} AS p, {hits("clean_text", LEXICON.negative)} AS n
  FROM {source} WHERE {where}),
found AS (
  SELECT *, list_filter([{_FOUND}], lambda a: a IS NOT NULL) AS specific FROM counted),
labeled AS (
  SELECT *, CASE WHEN len(specific) > 0 THEN specific ELSE ['GENERAL'] END AS aspects,
         {BY_STARS} AS sentiment_rule, {BY_WORDS} AS sentiment_words FROM found)"""


LABELED = f"{CLEANED},\n{labels_of('cleaned', 'word_count >= 3')}"
ALL_LABELED = f"{CLEANED},\n{labels_of('cleaned', 'true')}"

JOINED = "array_to_string(aspects, '|')"
HITS_TEXT = "concat_ws(',', " + ", ".join(f"CASE WHEN h{i} > 0 THEN '{a}:' || h{i} END" for i, a in enumerate(ASPECTS)) + ")"
MOOD_ID = "CASE {} WHEN 'Positif' THEN 0 WHEN 'Netral' THEN 1 WHEN 'Negatif' THEN 2 ELSE 1 END"
MOOD_SCORE = "CASE {} WHEN 'Positif' THEN 1 WHEN 'Negatif' THEN -1 ELSE 0 END"
GRID = (
    "grid AS (SELECT aspect, sentiment FROM (SELECT unnest(["
    + ", ".join(q(a) for a in ASPECTS)
    + "]) AS aspect) CROSS JOIN (SELECT unnest(['Positif', 'Netral', 'Negatif']) AS sentiment))"
)
PAIRS = "pairs AS (SELECT review_id, rating, unnest(aspects) AS aspect, sentiment_rule AS sentiment FROM labeled)"
COUNTS = "counts AS (SELECT aspect, sentiment, count(*) AS n FROM pairs GROUP BY ALL)"
DENSE = f"""{LABELED}, {PAIRS}, {COUNTS}, {GRID},
dense AS (SELECT aspect, sentiment, CAST(coalesce(n, 0) AS BIGINT) AS n FROM grid LEFT JOIN counts USING (aspect, sentiment)),
shares AS (SELECT *, coalesce(100.0 * n / nullif(sum(n) OVER (PARTITION BY aspect), 0), 0) AS pct FROM dense)"""
TITLE = "CASE {0} " + " ".join(
    f"WHEN '{a}' THEN '{a.replace('_', ' ').title()}'" for a in [*ASPECTS, "GENERAL"]
) + " END"

FEATURES = [f"{a}_{part}" for a in ASPECTS for part in ("present", "sentiment")]
_FEATURE_SQL = ", ".join(
    f"CAST(list_contains(aspects, '{a}') AS INT) AS \"{a}_present\", "
    f"CASE WHEN list_contains(aspects, '{a}') THEN {MOOD_SCORE.format('sentiment_rule')} ELSE 0 END AS \"{a}_sentiment\""
    for a in ASPECTS
)
REG = f"""{LABELED},
reg AS (SELECT review_id, doc_id, rating, {_FEATURE_SQL} FROM labeled WHERE rating IS NOT NULL)"""

_SCORED_ROWS = " UNION ALL ".join(
    f"SELECT review_id, '{a}' AS aspect, CAST(list_contains(aspects, '{a}') AS INT) AS aspect_true, "
    f"0.05 + 0.9 * (0.4 * CAST(list_contains(aspects, '{a}') AS INT) + 0.6 * {unit(a, 'review_id')}) AS aspect_prob, "
    f"CASE WHEN list_contains(aspects, '{a}') THEN {MOOD_ID.format('sentiment_rule')} ELSE -1 END AS sentiment_true, "
    f"CASE WHEN {unit('mood', 'review_id')} >= 0.8 THEN ({MOOD_ID.format('sentiment_rule')} + 1) % 3 "
    f"ELSE {MOOD_ID.format('sentiment_rule')} END AS sentiment_pred FROM labeled"
    for a in ASPECTS
)
LONG = f"""{LABELED},
long AS (SELECT *, CAST(aspect_prob >= 0.5 AS INT) AS aspect_pred FROM ({_SCORED_ROWS}))"""
ASPECT_F1 = """af AS (
  SELECT aspect, count(*) FILTER (aspect_true = 1 AND aspect_pred = 1) AS tp,
         count(*) FILTER (aspect_true = 0 AND aspect_pred = 1) AS fp,
         count(*) FILTER (aspect_true = 1 AND aspect_pred = 0) AS fn FROM long GROUP BY aspect),
af1 AS (SELECT aspect, coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM af)"""
CLASS_F1 = """known AS (SELECT * FROM long WHERE sentiment_true <> -1),
classes AS (SELECT aspect, sentiment_true AS class FROM known UNION SELECT aspect, sentiment_pred FROM known),
per_class AS (
  SELECT c.aspect, c.class,
         count(*) FILTER (k.sentiment_true = c.class AND k.sentiment_pred = c.class) AS tp,
         count(*) FILTER (k.sentiment_true = c.class) AS support,
         count(*) FILTER (k.sentiment_pred = c.class) AS predicted
  FROM classes c JOIN known k USING (aspect) GROUP BY ALL),
class_f1 AS (SELECT *, coalesce(2.0 * tp / nullif(support + predicted, 0), 0) AS f1 FROM per_class),
mood_f1 AS (SELECT aspect, avg(f1) AS sentiment_f1 FROM class_f1 GROUP BY aspect)"""
COMBINED = f"""{LONG}, {ASPECT_F1}, {CLASS_F1},
both_f1 AS (SELECT (SELECT avg(f1) FROM af1) AS aspect_f1_macro,
                   (SELECT avg(round(sentiment_f1, 4)) FROM mood_f1) AS sentiment_f1_avg)"""
EPOCHS = """log AS (
  SELECT CAST(dayofmonth(ts) AS INT) AS epoch, avg(value) AS train_loss,
         avg(CAST(event_type = 'purchase' AS INT)) AS val_aspect_f1_macro,
         avg(CAST(event_type = 'click' AS INT)) AS val_sentiment_f1_avg FROM events GROUP BY ALL)"""
LOG_ROWS = f"""WITH {EPOCHS}
SELECT epoch, round(train_loss, 9) AS train_loss, round(val_aspect_f1_macro, 9) AS val_aspect_f1_macro,
       round(val_sentiment_f1_avg, 9) AS val_sentiment_f1_avg FROM log"""
SUMMARY = "array_to_string(list_transform(aspects, lambda a: a || '=' || sentiment_words), ' | ')"
NAIVE = "CASE WHEN rating >= 4 THEN 'Positif' WHEN rating <= 2 THEN 'Negatif' ELSE 'Netral' END"


def reviews_only(select: str) -> str:
    return f"WITH {REVIEWS} {select}"


def labeled_only(select: str) -> str:
    return f"WITH {LABELED} {select}"


def _terms(group: str, source: str) -> str:
    stop = ", ".join(q(w) for w in STOP_WORDS)
    return f"""tokens AS (SELECT aspects, unnest({tokens("clean_text")}) AS term FROM {source}),
kept AS (SELECT unnest(aspects) AS {group}, term FROM tokens WHERE length(term) >= 2 AND term NOT IN ({stop})),
terms AS (SELECT {group}, term, count(*) AS n FROM kept GROUP BY ALL)"""


_LANGUAGES = sorted(LANGUAGE_PROFILES)
_LANG_HITS = ", ".join(
    f"len(list_filter(w, lambda x: x IN ({', '.join(q(t) for t in LANGUAGE_PROFILES[c])}))) AS hits_{c}" for c in _LANGUAGES
)
_LANG_BEST = "greatest(" + ", ".join(f"hits_{c}" for c in _LANGUAGES) + ")"
LANG = f"""{CLEANED},
lang_words AS MATERIALIZED (SELECT review_id, {tokens("clean_text")} AS w FROM cleaned),
lang_hits AS (SELECT review_id, {_LANG_HITS} FROM lang_words),
guesses AS (SELECT review_id, CASE WHEN {_LANG_BEST} = 0 THEN 'unknown' {" ".join(f"WHEN hits_{c} = {_LANG_BEST} THEN '{c}'" for c in _LANGUAGES)} END AS guess
  FROM lang_hits)"""


# Runs of three letters or blanks; the fifth of the texts with the smallest hashes is held out.
FITTED_LANG = f"""plain AS (SELECT review_id, lang, {unit("lang", "review_id")} < 0.2 AS held,
  trim(regexp_replace(lower(coalesce(review_text, '')), '[^\\p{{L}}]+', ' ', 'g'), ' ') AS p FROM reviews),
letters AS (SELECT review_id, lang, held, string_split(' ' || p || ' ', '') AS c FROM plain WHERE p <> ''),
all_runs AS MATERIALIZED (SELECT review_id, lang, held, run, count(*) AS n
  FROM (SELECT review_id, lang, held, unnest(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2])) AS run FROM letters)
  GROUP BY ALL),
learnt AS MATERIALIZED (SELECT lang, run, sum(n) AS n FROM all_runs WHERE NOT held AND lang IS NOT NULL GROUP BY ALL),
lang_size AS (SELECT lang, sum(n) AS total FROM learnt GROUP BY lang),
kept_runs AS MATERIALIZED (SELECT DISTINCT run FROM (SELECT run, row_number() OVER (PARTITION BY lang ORDER BY n DESC, run) AS k FROM learnt) WHERE k <= 2000),
run_score AS (SELECT lang, run, ln((coalesce(n, 0) + 1.0) / (total + (SELECT count(*) FROM kept_runs) + 1)) AS s
  FROM (SELECT * FROM lang_size, kept_runs) LEFT JOIN learnt USING (lang, run)),
other_score AS (SELECT lang, ln(1.0 / (total + (SELECT count(*) FROM kept_runs) + 1)) AS s FROM lang_size),
text_score AS (SELECT review_id, o.lang, sum(a.n * coalesce(r.s, o.s)) AS s, sum(a.n) AS m
  FROM all_runs a CROSS JOIN other_score o LEFT JOIN run_score r ON r.run = a.run AND r.lang = o.lang WHERE a.held GROUP BY ALL),
placed AS (SELECT *, row_number() OVER w AS k, (s - lead(s) OVER w) / m AS margin FROM text_score WINDOW w AS (PARTITION BY review_id ORDER BY s DESC, lang)),
fitted AS (SELECT review_id, CASE WHEN margin >= 0.02 THEN b.lang ELSE 'unknown' END AS guess, margin
  FROM plain LEFT JOIN (SELECT * FROM placed WHERE k = 1) b USING (review_id) WHERE held)"""


def _gram() -> str:
    columns = [*FEATURES, "rating"]
    sums = [f'CAST(sum("{c}") AS BIGINT) AS s_{i}' for i, c in enumerate(columns)]
    sums += [
        f'CAST(sum("{columns[i]}" * "{columns[j]}") AS BIGINT) AS p_{i}_{j}'
        for i in range(len(columns))
        for j in range(i, len(columns))
    ]
    return (
        f"WITH {REG}, folded AS (SELECT *, CAST(floor({unit('fold', 'doc_id')} * 5) AS INT) AS fold FROM reg) "
        f"SELECT fold, count(*) AS n, {', '.join(sums)} FROM folded GROUP BY fold"
    )


def _ridge(select: str) -> str:
    """The ridge fits from the rows themselves: one table of the standardised columns in long form,
    its cross-products, and a recursion that clears one pivot a step."""
    k = len(FEATURES)
    mean = {c: f'avg("{c}") OVER ()' for c in FEATURES}
    scaled = ", ".join(
        f'("{c}" - {mean[c]}) / CASE WHEN stddev_pop("{c}") OVER () < 1e-12 THEN 1 ELSE stddev_pop("{c}") OVER () END AS x{i}'
        for i, c in enumerate(FEATURES)
    )
    names = [f"x{i}" for i in range(k)] + ["y"]
    train = ", ".join(f"avg({c}) AS m_{c}" for c in names)
    matrix = ", ".join(
        "[" + ", ".join(f"sum(({a} - m_{a}) * ({b} - m_{b}))" + (" + alpha" if a == b else "") for b in names) + "]" for a in names[:-1]
    )
    guess = "m_y + " + " + ".join(f"coef[{i + 1}] * (x{i} - m_x{i})" for i in range(k))
    feature = ", ".join(q(f) for f in FEATURES)
    return f"""WITH RECURSIVE {REG}, folded AS (SELECT *, CAST(floor({unit('fold', 'doc_id')} * 5) AS INT) AS fold FROM reg),
        scaled AS (SELECT fold, CAST(rating AS DOUBLE) AS y, {scaled} FROM folded),
        grid AS (SELECT pow(10, -3 + 6.0 * i / 49) AS alpha FROM range(50) t(i)),
        parts AS (SELECT DISTINCT fold AS part FROM scaled UNION ALL SELECT -1),
        means AS (SELECT part, {train} FROM parts, scaled WHERE fold <> part GROUP BY part),
        cross_ AS (SELECT part, alpha, [{matrix}] AS m FROM means, scaled, grid WHERE fold <> part GROUP BY part, alpha),
        steps AS (
          SELECT part, alpha, 1 AS i, m FROM cross_
          UNION ALL SELECT part, alpha, i + 1, list_transform(m, lambda r, j: list_transform(r, lambda x, c:
            CASE WHEN j = i THEN x / m[i][i] ELSE x - r[i] * m[i][c] / m[i][i] END)) FROM steps WHERE i <= {k}),
        fits AS (SELECT part, alpha, list_transform(m, lambda r: r[{k + 1}]) AS coef FROM steps WHERE i = {k + 1}),
        errors AS (SELECT part, alpha, any_value(coef) AS coef, sum((y - ({guess})) ** 2) AS e, count(*) AS n, count(*) * var_pop(y) AS total
          FROM fits JOIN means USING (part) JOIN scaled ON fold = part OR part = -1 GROUP BY part, alpha),
        cv AS (SELECT alpha, avg(1 - e / total) AS cv_r2 FROM errors WHERE part >= 0 AND total > 1e-9 GROUP BY alpha),
        best AS (SELECT alpha, cv_r2, 1 - e / total AS r2, sqrt(e / n) AS rmse, unnest([{feature}]) AS feature, unnest(coef) AS coefficient
          FROM errors JOIN (SELECT * FROM cv ORDER BY cv_r2 DESC, alpha LIMIT 1) USING (alpha) WHERE part = -1)
        {select}"""


def _slopes() -> str:
    return " UNION ALL ".join(
        f"SELECT '{f}' AS feature, coalesce(covar_pop(rating, \"{f}\") / nullif(var_pop(\"{f}\"), 0), 0) AS coefficient FROM reg"
        for f in FEATURES
    )


def _standard() -> str:
    scaled = ", ".join(
        f'round(("{f}" - avg("{f}") OVER ()) / coalesce(nullif(stddev_pop("{f}") OVER (), 0), 1), 9) AS "{f}"' for f in FEATURES
    )
    return f"WITH {REG} SELECT review_id, {scaled} FROM reg"


def _ratios() -> str:
    parts = []
    for a in ASPECTS:
        inside = f"FILTER (list_contains(aspects, '{a}'))"
        for mood, suffix in (("Positif", "pos_ratio"), ("Negatif", "neg_ratio"), ("Netral", "net_ratio")):
            parts.append(f"round(coalesce(avg(CAST(sentiment_rule = '{mood}' AS INT)) {inside}, 0), 9) AS \"{a}_{suffix}\"")
        parts.append(f"round(coalesce(avg({MOOD_SCORE.format('sentiment_rule')}) {inside}, 0), 9) AS \"{a}_score\"")
    return f"WITH {LABELED} SELECT {', '.join(parts)} FROM labeled"


def _split(key: str) -> str:
    u = unit("42", key)
    return f"CASE WHEN {u} < 0.70 THEN 'train' WHEN {u} < 0.70 + 0.15 THEN 'val' ELSE 'test' END"


def _rule(expression: str, before: str = "review_text") -> str:
    return reviews_only(f"SELECT review_id, {expression} AS after FROM (SELECT review_id, {before} AS b FROM reviews)")


# Pairs that start two pieces apart overlap: of a chain of them every second one counts.
LEXICON_COUNTS = rf"""
, t AS (SELECT review_id, lower(coalesce(review_text, '')) AS t FROM reviews),
w AS (SELECT review_id, unnest(regexp_extract_all(t, '[{WORD}]+')) AS term FROM t),
known AS (SELECT term FROM w GROUP BY term HAVING count(DISTINCT review_id) > 1),
pairs AS (SELECT DISTINCT regexp_extract(t, '[{WORD}]+ [{WORD}]+') AS term FROM t),
p AS (SELECT review_id, regexp_extract_all(t, '[{WORD}]+|[^{WORD}]') AS p FROM t),
j AS (SELECT review_id, p, unnest(range(1, len(p) - 1)) AS i FROM p),
starts AS (SELECT review_id, i FROM j JOIN pairs ON pairs.term = p[i] || p[i + 1] || p[i + 2]
           WHERE p[i + 1] = ' ' AND regexp_matches(p[i], '^[{WORD}]') AND regexp_matches(p[i + 2], '^[{WORD}]')),
chains AS (SELECT review_id, c, count(*) AS n
           FROM (SELECT review_id, i - 2 * row_number() OVER (PARTITION BY review_id, i % 2 ORDER BY i) AS c, i % 2 AS o FROM starts)
           GROUP BY review_id, c, o)
SELECT review_id, 'length ' || least(length(term), 9) AS label, count(*) AS hits FROM w JOIN known USING (term) GROUP BY ALL
UNION ALL
SELECT review_id, 'pair', CAST(sum((n + 1) // 2) AS BIGINT) FROM chains GROUP BY review_id
"""


def oracle_sql() -> dict[str, str]:
    hit_lists = {f"hits_{i}": terms for i, terms in enumerate(LEXICON.aspects.values())}
    hit_lists |= {"hits_positive": LEXICON.positive, "hits_negative": LEXICON.negative}
    raw_hits = ", ".join(f"{hits('review_text', terms)} AS {name}" for name, terms in hit_lists.items())
    membership = " UNION ALL ".join(
        f"SELECT review_id, '{a}' AS aspect FROM counted WHERE h{i} > 0" for i, a in enumerate(ASPECTS)
    )
    ids = ", ".join(
        f"CASE WHEN list_contains(aspects, '{a}') THEN {MOOD_ID.format('sentiment_rule')} ELSE -1 END" for a in ASPECTS
    )
    loss = """SELECT round(a, 8) AS aspect_loss, round(s, 8) AS sentiment_loss, round(a + s, 8) AS total_loss FROM (
      SELECT -avg(aspect_true * ln(aspect_prob) + (1 - aspect_true) * ln(1 - aspect_prob)) AS a,
             sum(w * -ln(p)) FILTER (sentiment_true >= 0) / sum(w) FILTER (sentiment_true >= 0) AS s
      FROM (SELECT *, CASE sentiment_true WHEN 0 THEN 0.2 WHEN 1 THEN 0.3 WHEN 2 THEN 0.5 END AS w,
                   CASE WHEN sentiment_true = sentiment_pred THEN 0.7 ELSE 0.15 END AS p FROM long))"""
    landed = """feed AS (
      SELECT review_id, review_text, rating, 0 AS helpful_count, 0 AS feed_rank FROM reviews
      UNION ALL SELECT review_id, review_text, rating, 1, 1 FROM reviews WHERE doc_id IN (SELECT doc_id FROM labels)),
    firsts AS (SELECT * FROM feed QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY feed_rank) = 1)"""
    stripped = sub("review_text", rf"^[{SPACE}]+|[{SPACE}]+$", "")
    return {
        # sources and sinks
        "scan_reviews": reviews_only("SELECT review_id, review_text, rating FROM reviews"),
        "sink_table": labeled_only(
            f"""SELECT review_id, clean_text, {JOINED} AS aspects, sentiment_rule,
            '{{' || concat_ws(',', {", ".join(f"CASE WHEN h{i} > 0 THEN '\"{a}\":' || h{i} END" for i, a in enumerate(ASPECTS))}) || '}}' AS matched_keywords,
            len(aspects) > 1 AS is_multilabel FROM labeled"""
        ),
        "sink_json_report": f"WITH {DENSE} SELECT aspect, sentiment, n, round(pct, 2) AS pct FROM shares",
        "scan_training_log": LOG_ROWS,
        "ingest_pages": f"""WITH {REVIEWS}, {landed}
            SELECT review_id, review_text, rating, helpful_count, {NAIVE} AS sentiment_label_naive
            FROM firsts WHERE review_text IS NOT NULL AND length({stripped}) > 5""",
        "conform_schema": reviews_only("SELECT review_id, review_text, rating, source FROM reviews"),
        "score_file": f"WITH {ALL_LABELED} SELECT review_id, nullif(clean_text, '') AS clean_text, {JOINED} AS aspects, {SUMMARY} AS summary FROM labeled",
        # projections and filters
        "filter_nonnull_text": reviews_only("SELECT review_id, review_text FROM reviews WHERE rating IS NOT NULL AND review_text IS NOT NULL"),
        "filter_min_length": reviews_only(f"SELECT review_id FROM reviews WHERE length({stripped}) > 5"),
        "naive_sentiment": reviews_only(f"SELECT review_id, rating, {NAIVE} AS sentiment_label_naive FROM reviews"),
        "filter_min_words": f"WITH {CLEANED} SELECT review_id, word_count FROM cleaned WHERE word_count >= 3",
        "aspect_filter": labeled_only("SELECT review_id, sentiment_rule FROM labeled WHERE list_contains(aspects, 'PRIVACY')"),
        "aspect_membership": labeled_only(
            "SELECT review_id, " + ", ".join(f"list_contains(aspects, '{a}') AS has_{a.lower()}" for a in ASPECTS) + " FROM labeled"
        ),
        "annotation_projection": labeled_only(
            f"""SELECT review_id, review_text, clean_text, rating, {JOINED} AS aspects, sentiment_rule,
            '' AS aspect_annotator_1, '' AS sentiment_annotator_1, '' AS aspect_annotator_2,
            '' AS sentiment_annotator_2, '' AS agreement, '' AS notes FROM labeled"""
        ),
        "fill_defaults": reviews_only(
            "SELECT review_id, coalesce(rating, 0) AS stars, 3 AS rating, 'Netral' AS sentiment_rule FROM reviews"
        ),
        "bind_label_columns": labeled_only(
            f"SELECT review_id, {JOINED} AS aspects, CAST(len(aspects) AS INT) AS aspect_count, sentiment_rule, len(aspects) > 1 AS is_multilabel, rating, lang FROM labeled"
        ),
        "row_ordinal": reviews_only(
            f"SELECT doc_id, review_id, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal FROM reviews WHERE length({stripped}) > 5"
        ),
        "filter_audit": f"""WITH {CLEANED}, a AS (SELECT count(*) AS n0, count(*) FILTER (review_text IS NOT NULL) AS n1,
            count(*) FILTER (review_text IS NOT NULL AND length({stripped}) > 5) AS n2,
            count(*) FILTER (review_text IS NOT NULL AND length({stripped}) > 5 AND word_count >= 3) AS n3 FROM cleaned)
            SELECT 1 AS step, 'has_text' AS filter, n0 AS rows_before, n1 AS rows_after, n0 - n1 AS rows_removed FROM a
            UNION ALL SELECT 2, 'long_enough', n1, n2, n1 - n2 FROM a
            UNION ALL SELECT 3, 'enough_words', n2, n3, n2 - n3 FROM a""",
        "filter_audit_written": f"""WITH {CLEANED}, a AS (SELECT count(*) AS n0, count(*) FILTER (review_text IS NOT NULL) AS n1,
            count(*) FILTER (review_text IS NOT NULL AND length({stripped}) > 5) AS n2,
            count(*) FILTER (review_text IS NOT NULL AND length({stripped}) > 5 AND word_count >= 3) AS n3 FROM cleaned)
            SELECT 1 AS step, 'has_text' AS filter, n0 AS rows_before, n1 AS rows_after, n0 - n1 AS rows_removed, n3 AS rows_written FROM a
            UNION ALL SELECT 2, 'long_enough', n1, n2, n1 - n2, n3 FROM a
            UNION ALL SELECT 3, 'enough_words', n2, n3, n2 - n3, n3 FROM a""",
        # lookups
        "slang_lookup": reviews_only(f"SELECT review_id, {_raw_slang('review_text')} AS normalized FROM reviews"),
        "slang_lookup_join": reviews_only(f"SELECT review_id, {_raw_slang('review_text')} AS normalized FROM reviews"),
        "lexicon_match_join": f"WITH {ALL_LABELED} {membership}",
        "label_score_map": labeled_only(
            f"SELECT review_id, sentiment_rule, {MOOD_SCORE.format('sentiment_rule')} AS sentiment_score, {MOOD_ID.format('sentiment_rule')} AS sentiment_id FROM labeled"
        ),
        "dense_grid_join": f"""WITH {LABELED}, {GRID}, {PAIRS},
            chosen AS (SELECT aspect, sentiment, count(*) AS n FROM pairs
              WHERE rating >= 4 AND review_id IN (SELECT review_id FROM pairs WHERE aspect = 'PRIVACY') GROUP BY ALL)
            SELECT aspect, sentiment, CAST(coalesce(n, 0) AS BIGINT) AS n FROM grid LEFT JOIN chosen USING (aspect, sentiment)""",
        "aspect_semi_anti": labeled_only(
            "SELECT review_id, CASE WHEN len(specific) > 0 THEN 'with' ELSE 'without' END AS side FROM labeled"
        ),
        # aggregations
        "rating_histogram": reviews_only("SELECT rating, count(*) AS n FROM reviews WHERE rating IS NOT NULL GROUP BY rating"),
        "naive_sentiment_counts": reviews_only(f"SELECT {NAIVE} AS sentiment, count(*) AS n FROM reviews GROUP BY ALL ORDER BY n DESC, sentiment"),
        "lang_distribution": f"WITH {LANG} SELECT guess, count(*) AS n FROM guesses GROUP BY guess",
        "word_count_summary": f"WITH {CLEANED} SELECT count(*) AS total, round(avg(word_count), 6) AS mean_words, CAST(median(word_count) AS DOUBLE) AS median_words FROM cleaned WHERE word_count >= 3",
        "aspect_distribution": f"""WITH {LABELED}, {PAIRS}, names AS (SELECT unnest([{", ".join(q(a) for a in [*ASPECTS, "GENERAL"])}]) AS aspect)
            SELECT aspect, count(review_id) AS n, round(coalesce(100.0 * count(review_id) / nullif((SELECT count(*) FROM labeled), 0), 0), 6) AS percentage
            FROM names LEFT JOIN pairs USING (aspect) GROUP BY aspect""",
        "aspect_sentiment_counts": f"WITH {LABELED}, {PAIRS}, {COUNTS} SELECT * FROM counts",
        "aspect_sentiment_pct": f"WITH {DENSE} SELECT aspect, {TITLE.format('aspect')} AS aspect_label, sentiment, n, round(pct, 6) AS pct FROM shares",
        "aspect_sentiment_pivot": f"""WITH {DENSE} SELECT aspect, CAST(sum(n) FILTER (sentiment = 'Positif') AS BIGINT) AS "Positif",
            CAST(sum(n) FILTER (sentiment = 'Netral') AS BIGINT) AS "Netral",
            CAST(sum(n) FILTER (sentiment = 'Negatif') AS BIGINT) AS "Negatif" FROM dense GROUP BY aspect""",
        "aspect_ratio_features": _ratios(),
        "class_weights": f"""WITH {LABELED}, ids AS (SELECT {MOOD_ID.format('sentiment_rule')} AS sentiment_id FROM labeled, unnest(specific)),
            c AS (SELECT k.sentiment_id, count(ids.sentiment_id) AS n FROM (SELECT unnest([0, 1, 2]) AS sentiment_id) k LEFT JOIN ids USING (sentiment_id) GROUP BY ALL)
            SELECT sentiment_id, n, round(1 / (n + 1e-9) / sum(1 / (n + 1e-9)) OVER (), 9) AS weight FROM c""",
        "aspect_f1_macro": f"WITH {LONG}, {ASPECT_F1} SELECT round(avg(f1), 9) AS aspect_f1_macro FROM af1",
        "sentiment_f1_per_aspect": f"WITH {LONG}, {CLASS_F1} SELECT aspect, round(sentiment_f1, 9) AS sentiment_f1 FROM mood_f1",
        "sentiment_f1_avg": f"WITH {COMBINED} SELECT round(sentiment_f1_avg, 9) AS sentiment_f1_avg FROM both_f1",
        "combined_f1": f"""WITH {COMBINED} SELECT round(aspect_f1_macro, 9) AS aspect_f1_macro, round(sentiment_f1_avg, 9) AS sentiment_f1_avg,
            round((aspect_f1_macro + sentiment_f1_avg) / 2, 9) AS combined_f1 FROM both_f1""",
        "confusion_matrix": f"""WITH {LONG}, m AS (SELECT aspect, sentiment_true,
              {", ".join(f"count(*) FILTER (sentiment_pred = {c}) AS n_{c}" for c in range(3))}, count(*) AS total
              FROM long WHERE sentiment_true <> -1 GROUP BY ALL)
            SELECT aspect, sentiment_true, n_0, n_1, n_2, {", ".join(f"round(n_{c} / (total + 1e-9), 9) AS rate_{c}" for c in range(3))} FROM m""",
        "classification_report": f"""WITH {LONG}, {CLASS_F1},
            acc AS (SELECT aspect, avg(CAST(sentiment_true = sentiment_pred AS INT)) AS accuracy FROM known GROUP BY aspect)
            SELECT aspect, class, round(coalesce(tp / nullif(predicted, 0), 0), 9) AS precision,
              round(coalesce(tp / nullif(support, 0), 0), 9) AS recall, round(f1, 9) AS f1, support, round(accuracy, 9) AS accuracy
            FROM class_f1 JOIN acc USING (aspect)""",
        "epoch_mean_loss": "SELECT CAST(dayofmonth(ts) AS INT) AS epoch, round(avg(value), 9) AS train_loss, count(*) AS steps FROM events GROUP BY ALL",
        "gram_matrix": _gram(),
        "ridge_cv": _ridge(
            """SELECT feature, round(coefficient, 6) + 0.0 AS coefficient, round(abs(coefficient), 6) AS abs_coef,
            CASE WHEN coefficient > 1e-9 THEN 'Positif (↑ Rating)' WHEN coefficient < -1e-9 THEN 'Negatif (↓ Rating)' END AS direction,
            round(r2, 6) AS r2, round(rmse, 6) AS rmse, round(cv_r2, 6) AS cv_r2, round(alpha, 6) AS alpha FROM best"""
        ),
        "report_regression": _ridge(
            """, one AS (SELECT DISTINCT r2, rmse, cv_r2, alpha FROM best)
            SELECT measure, round(value, 6) AS value FROM (SELECT unnest(['r2', 'rmse', 'cv_r2', 'alpha']) AS measure, unnest([r2, rmse, cv_r2, alpha]) AS value FROM one)"""
        ),
        "regression_metrics": f"""WITH {LABELED}, r AS (SELECT rating, 3 + {MOOD_SCORE.format('sentiment_rule')} AS prediction FROM labeled WHERE rating IS NOT NULL)
            SELECT round(1 - sum((rating - prediction) ** 2) / (count(*) * var_pop(rating)), 9) AS r2,
              round(sqrt(avg((rating - prediction) ** 2)), 9) AS rmse FROM r""",
        "log_loss": f"WITH {LONG} {loss}",
        "annotator_agreement": labeled_only(
            """SELECT review_id, sentiment_rule AS sentiment_annotator_1, sentiment_words AS sentiment_annotator_2,
            CASE WHEN sentiment_rule = sentiment_words THEN 'Y' ELSE 'N' END AS agreement FROM labeled"""
        ),
        "agreement_share": labeled_only(
            "SELECT count(*) AS reviews, round(avg(CAST(sentiment_rule = sentiment_words AS INT)), 9) AS agreement_share FROM labeled"
        ),
        # windows
        "dedup_keep_first": "SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) = 1",
        "stratified_sample": reviews_only(
            """SELECT review_id, rating FROM (SELECT *, row_number() OVER (PARTITION BY rating ORDER BY md5('42:' || review_id), review_id) AS k
            FROM reviews WHERE rating IS NOT NULL) WHERE k <= 100 ORDER BY md5('42:' || review_id), review_id LIMIT 500"""
        ),
        "pct_within_group": f"WITH {LABELED}, {PAIRS}, {COUNTS} SELECT aspect, sentiment, n, round(100.0 * n / sum(n) OVER (PARTITION BY aspect), 6) AS pct FROM counts",
        "best_checkpoint": f"""WITH {EPOCHS}, c AS (SELECT epoch, (val_aspect_f1_macro + val_sentiment_f1_avg) / 2 AS combined_f1 FROM log)
            SELECT epoch, round(combined_f1, 9) AS combined_f1 FROM c WHERE combined_f1 > 0 ORDER BY c.combined_f1 DESC, epoch LIMIT 1""",
        "top_terms_per_group": f"""WITH {LABELED}, {_terms("aspect", "labeled")},
            ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY aspect ORDER BY n DESC, term) AS INT) AS rank FROM terms)
            SELECT * FROM ranked WHERE rank <= 80""",
        "kfold_assign": reviews_only("SELECT doc_id, CAST(ntile(5) OVER (ORDER BY doc_id) - 1 AS INT) AS fold FROM reviews WHERE rating IS NOT NULL"),
        # sort, limit, samples
        "coef_ranking": f"""WITH {REG}, slopes AS ({_slopes()})
            SELECT feature, round(coefficient, 9) AS coefficient,
              CASE WHEN coefficient > 0 THEN 'Positif (↑ Rating)' ELSE 'Negatif (↓ Rating)' END AS direction
            FROM slopes ORDER BY abs(slopes.coefficient) DESC, feature LIMIT 5""",
        "sorted_histogram": reviews_only("SELECT rating, count(*) AS n FROM reviews WHERE rating IS NOT NULL GROUP BY rating ORDER BY rating"),
        "random_sample": reviews_only("SELECT review_id, rating FROM reviews ORDER BY md5('42:' || review_id), review_id LIMIT 100"),
        "shuffle_limit": reviews_only("SELECT review_id FROM reviews ORDER BY md5('7:' || review_id), review_id LIMIT 250"),
        "cap_rows": "SELECT CAST(doc_id AS VARCHAR) AS review_id FROM documents ORDER BY doc_id LIMIT 500",
        "train_val_test_split": reviews_only(f"SELECT review_id, {_split('review_id')} AS split FROM reviews"),
        # set operations
        "union_feeds_distinct": f"""WITH {REVIEWS}, feed AS (
              SELECT CAST(conv_id AS VARCHAR) AS review_id, text AS review_text, turn, 0 AS feed_rank FROM conversations
              UNION ALL SELECT review_id, review_text, NULL, 1 FROM reviews)
            SELECT review_id, review_text, turn, feed_rank FROM feed
            QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY feed_rank, turn, review_text) = 1""",
        "stack_batches": """SELECT 'documents' AS batch, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents
            UNION ALL SELECT 'conversations', count(*), CAST(sum(length(text)) AS BIGINT) FROM conversations""",
        # text cleaning
        "clean_guard": _rule(f"CASE WHEN regexp_matches(coalesce(b, ''), '[^{SPACE}]') THEN b ELSE '' END"),
        "clean_nfc": _rule("nfc_normalize(b)", "replace(review_text, 'é', 'e' || chr(769))"),
        "clean_emoji": _rule(emoji("b"), "replace(review_text, ' que ', ' ' || chr(128512) || ' ' || chr(9728) || chr(65039) || ' ')"),
        "clean_mentions": _rule(mentions("b"), "replace(review_text, ' que ', ' @que #que_é ')"),
        "collapse_repeats": _rule(repeats("b")),
        "collapse_punct": _rule(punctuation("b")),
        "clean_lower": _rule("lower(b)"),
        "normalize_slang": _rule(_raw_slang("lower(b)")),
        "clean_special": _rule(special("b")),
        "clean_whitespace": _rule(space("b")),
        "fallback_clean": _rule(sub("lower(b)", rf"^[{SPACE}]+|[{SPACE}]+$", "")),
        "clean_html": f"SELECT page_id, {html('html')} AS after FROM pages",
        "clean_urls": f"SELECT page_id, {urls('t')} AS after FROM (SELECT page_id, html || ' ' || url || ' www.example.org/x end' AS t FROM pages)",
        "stem_lookup": f"WITH {REVIEWS}, {chain('reviews', stems=True)} SELECT review_id, clean_text AS clean_text_stem FROM chain_done",
        "clean_text": f"WITH {CLEANED} SELECT review_id, clean_text FROM cleaned",
        "clean_pages": f"WITH p AS (SELECT page_id, html || ' ' || url AS review_text FROM pages), {chain('p')} SELECT page_id, clean_text FROM chain_done",
        "text_stats": reviews_only(
            f"SELECT review_id, CAST(length(review_text) AS INT) AS char_count, {word_count('review_text')} AS word_count, {sent_count('review_text')} AS sent_count FROM reviews"
        ),
        "detect_language": f"WITH {LANG} SELECT review_id, guess FROM guesses",
        "fitted_language": f"WITH {REVIEWS}, {FITTED_LANG} SELECT review_id, guess, round(margin, 6) AS margin FROM fitted",
        "fitted_language_quality": f"""WITH {REVIEWS}, {FITTED_LANG} SELECT lang, count(*) AS n, count(*) FILTER (guess = lang) AS n_right,
            count(*) FILTER (guess = 'unknown') AS n_unknown FROM fitted JOIN reviews USING (review_id) WHERE lang IS NOT NULL GROUP BY lang""",
        # labelling
        "compile_lexicon": reviews_only(f"SELECT review_id, {raw_hits} FROM reviews"),
        "joint_training_log": "SELECT CAST(range AS INT) AS epoch, true AS loss_falls, true AS scores_repeat, true AS kept_is_best FROM range(1, 5)",
        "joint_training_loss": "SELECT unnest(['aspect_loss', 'sentiment_loss', 'total_loss']) AS loss, true AS below_constant",
        "lexicon_counts": reviews_only(LEXICON_COUNTS),
        "label_reviews_by_table": labeled_only(
            f"SELECT review_id, {JOINED} AS aspects, CAST(len(aspects) AS INT) AS aspect_count, sentiment_rule, {HITS_TEXT} AS hits, len(aspects) > 1 AS is_multilabel FROM labeled"
        ),
        "detect_aspects": labeled_only(f"SELECT review_id, {JOINED} AS aspects FROM labeled"),
        "detect_sentiment": labeled_only("SELECT review_id, rating, sentiment_rule FROM labeled"),
        "matched_keywords": labeled_only(f"SELECT review_id, {HITS_TEXT} AS hits FROM labeled"),
        "label_reviews": labeled_only(
            f"""SELECT review_id, clean_text, char_count, word_count, sent_count, {JOINED} AS aspects,
            CAST(len(aspects) AS INT) AS aspect_count, sentiment_rule, {HITS_TEXT} AS hits, len(aspects) > 1 AS is_multilabel FROM labeled"""
        ),
        "aspects_join_split": labeled_only(
            f"""SELECT review_id, {JOINED} AS joined, CAST(i - 1 AS INT) AS position, aspects[i] AS aspect
            FROM (SELECT *, unnest(range(1, len(aspects) + 1)) AS i FROM labeled)"""
        ),
        "aspect_multihot": labeled_only(
            "SELECT review_id, " + ", ".join(f"CAST(list_contains(aspects, '{a}') AS INT) AS is_{a.lower()}" for a in ASPECTS) + " FROM labeled"
        ),
        "aspect_sentiment_ids": labeled_only(
            f"SELECT review_id, unnest([{', '.join(q(a) for a in ASPECTS)}]) AS aspect, unnest([{ids}]) AS sentiment_id FROM labeled"
        ),
        "aspect_regression_features": f"WITH {REG} SELECT * EXCLUDE (doc_id) FROM reg",
        "coef_direction": f"""WITH {REG}, slopes AS ({_slopes()})
            SELECT feature, CASE WHEN coefficient > 0 THEN 'Positif (↑ Rating)' ELSE 'Negatif (↓ Rating)' END AS direction FROM slopes""",
        "priority_tier": f"""WITH {DENSE} SELECT aspect, round(pct, 2) AS neg_pct,
            CASE WHEN round(pct, 2) > 40 THEN 'high' WHEN round(pct, 2) > 25 THEN 'watch' ELSE 'good' END AS tier
            FROM shares WHERE sentiment = 'Negatif'""",
        "aspect_title": f"WITH {LABELED}, {PAIRS} SELECT {TITLE.format('aspect')} AS title, count(*) AS n FROM pairs GROUP BY ALL",
        "summary_string": f"WITH {ALL_LABELED} SELECT review_id, {SUMMARY} AS summary FROM labeled",
        "text_preview": reviews_only("SELECT review_id, left(review_text, 80) || '...' AS preview FROM reviews"),
        "round_half_even": "SELECT event_id, round_even(floor(value) / 8.0, 2) AS rounded FROM events",
        "sigmoid_threshold": """SELECT event_id, round(p, 9) AS probability, p >= 0.5 AS at_least, p > 0.5 AS above
            FROM (SELECT event_id, 1 / (1 + exp(-((value - 50) / 10))) AS p FROM events)""",
        "argmax_class": "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INT) AS predicted FROM embeddings",
        # models that plain SQL can express
        "score_reviews_rules": f"""WITH {ALL_LABELED} SELECT review_id, clean_text, {JOINED} AS aspects,
            array_to_string(list_transform(aspects, lambda a: a || ':' || sentiment_words), ',') AS sentiments,
            0.0::DOUBLE AS confidence_first, {SUMMARY} AS summary FROM labeled""",
        "standardize": _standard(),
        "model_selection": """WITH c AS (SELECT event_type, CAST(dayofmonth(ts) AS INT) AS epoch, avg(value / 100) AS f1 FROM events GROUP BY ALL),
            b AS (SELECT epoch, max(f1) AS combined_f1 FROM c GROUP BY epoch)
            SELECT epoch, round(combined_f1, 9) AS combined_f1 FROM b ORDER BY b.combined_f1 DESC, epoch LIMIT 1""",
        "oversample_minority": """WITH c AS (SELECT toxic, count(*) AS n FROM labels GROUP BY toxic), m AS (SELECT max(n) AS m FROM c),
            r AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY md5('42:' || doc_id), doc_id) AS k FROM labels),
            x AS (SELECT doc_id, toxic, m // n + CAST(k <= m % n AS INT) AS copies FROM r JOIN c USING (toxic) CROSS JOIN m)
            SELECT doc_id, toxic, CAST(unnest(range(1, copies + 1)) AS INT) AS copy FROM x""",
        "term_frequencies": f"WITH {LABELED}, {_terms('aspect', 'labeled')} SELECT * FROM terms",
        # models: what must hold of any good fit
        "save_load_model": reviews_only("SELECT review_id, true AS agree FROM reviews"),
        "score_reviews": reviews_only("SELECT review_id, true AS follows FROM reviews"),
        "text_topic_costs": f"""WITH {CLEANED} SELECT CAST(range AS INT) AS start, (SELECT count(*) FROM cleaned WHERE clean_text <> '') AS texts,
            true AS not_cheaper, true AS cost_repeats, true AS below_one_centre FROM range(10)""",
        "text_topic_terms": f"""WITH {CLEANED} SELECT term, count(*) AS n
            FROM (SELECT unnest({tokens("clean_text")}) AS term FROM cleaned) GROUP BY term""",
        "kmeans_topics": "SELECT vec_id AS doc_id, label, true AS own_centre_is_nearest FROM embeddings",
        **dict.fromkeys(
            ("aspect_classifier", "sentiment_classifier"),
            " UNION ALL ".join(f"SELECT '{a}' AS aspect, true AS beats_constant" for a in ASPECTS),
        ),
        "tfidf_features": f"""WITH {LABELED}, t AS (SELECT review_id, unnest(string_split(lower(clean_text), ' ')) AS term FROM labeled),
            f AS (SELECT review_id, term, count(*) AS tf FROM t GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM f GROUP BY ALL)
            SELECT review_id, term, tf, round(ln((n + 1.0) / (df + 1)), 9) AS idf
            FROM f JOIN d USING (term), (SELECT count(*) AS n FROM labeled)""",
        # report
        "executive_report": f"""WITH {DENSE},
            neg AS (SELECT aspect, round(pct, 2) AS neg FROM shares WHERE sentiment = 'Negatif')
            SELECT 'dataset' AS section, 'total' AS item, NULL::VARCHAR AS detail, count(*) AS n, NULL::DOUBLE AS value FROM labeled
            UNION ALL SELECT 'rating', CAST(rating AS VARCHAR), NULL, count(*), NULL FROM labeled WHERE rating IS NOT NULL GROUP BY rating
            UNION ALL SELECT 'sentiment', aspect, sentiment, n, round(pct, 2) FROM shares
            UNION ALL SELECT 'tier', aspect, CASE WHEN neg > 40 THEN 'high' WHEN neg > 25 THEN 'watch' ELSE 'good' END, NULL, neg FROM neg""",
        "training_curves_table": LOG_ROWS + " ORDER BY epoch",
        # streams
        "stream_score": f"WITH {ALL_LABELED} SELECT review_id, {JOINED} AS aspects, CAST(len(aspects) AS INT) AS aspect_count, sentiment_rule, len(aspects) > 1 AS is_multilabel FROM labeled",
        "stream_dedup": reviews_only("SELECT review_id, review_text, rating FROM reviews"),
        "stream_first_arrival": f"WITH {REVIEWS}, {landed} SELECT review_id, review_text, rating, helpful_count FROM firsts",
        "stream_aspect_counts": f"""WITH {ALL_LABELED}
            SELECT day, aspect, sentiment, count(*) AS n FROM (
              SELECT strftime(review_date, '%Y-%m-%d') AS day, unnest(aspects) AS aspect, sentiment_rule AS sentiment FROM labeled)
            GROUP BY ALL""",
    }


def _raw_slang(text: str) -> str:
    """Slang lookup that keeps replacements as written, inner blanks included."""
    cases = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in LEXICON.slang.items())
    words = f"regexp_split_to_array({text}, {q(f'[{SPACE}]+')})"
    return f"array_to_string(list_filter(list_transform({words}, lambda w: CASE lower(w) {cases} ELSE w END), lambda w: w <> ''), ' ')"
