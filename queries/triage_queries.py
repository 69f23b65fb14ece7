"""Sentiment, urgency, priority, routing, reports and streams."""

from __future__ import annotations

import string

from pyspark.sql import functions as F

from queries.common import names, q, requests, sql_clean, sql_words, table, with_ctes
from triage import fixed_values as fv
from triage import fixtures
from triage.functions import polarity as po
from triage.functions import text as tx
from triage.operators import label as lb
from triage.operators import report as rp
from triage.operators import sentiment as se
from triage.operators import triage_rules as tr
from triage.plans.classify import classify, recent_classified, with_ticket_id
from triage.sources.folders import work_folder
from triage.sources.store import PredictionStore
from triage.streaming import online

CUSTOM = {"thank": -0.8, "dashboard": -0.1, "team": 0.05, "the ": -0.4}


def lexicon_polarity(spark, d):
    rows = requests(spark, d).withColumn("p", po.polarity("text"))
    return rows.select("ticket_id", *[F.col(f"p.{c}").alias(c) for c in POLES])


def user_turns(spark, d):
    """What users say in conversations, as tickets."""
    turns = table(spark, d, "conversations").where(F.col("role") == "user")
    return turns.select(F.concat_ws("-", "conv_id", "turn").alias("ticket_id"), "text")


def clean_conversations(spark, d):
    return user_turns(spark, d).select("ticket_id", tx.clean_text_or_empty("text").alias("out"))


def conversation_polarity(spark, d):
    rows = user_turns(spark, d).withColumn("p", po.polarity("text"))
    return rows.select("ticket_id", *[F.col(f"p.{c}").alias(c) for c in POLES])


def urgency_signals(spark, d):
    rows = requests(spark, d).withColumn("signals", se.urgency_signals("text"))
    return rows.select(
        "ticket_id", F.array_join("signals", "|").alias("signals"), F.size("signals").alias("hits")
    )


def rated(spark, d):
    """Polarity, urgency hits, plan and the rules' confidence of every ticket."""
    rows = lb.map_to_category(requests(spark, d)).withColumn("p", po.polarity("text"))
    return rows.select(
        "ticket_id",
        "customer_plan",
        se.urgency_hits("text").alias("hits"),
        "p.compound",
        "p.neg",
        F.when(F.col("category").isNotNull(), 1.0).otherwise(0.0).alias("confidence"),
    )


def boost_compound(spark, d):
    boosted = se.boost_compound(F.col("compound"), F.col("hits"))
    return rated(spark, d).select("ticket_id", F.round(boosted, 6).alias("compound"))


def sentiment_label(spark, d):
    label = se.sentiment_label(F.col("compound"), F.col("neg"), F.size("hits"))
    return rated(spark, d).select("ticket_id", label.alias("label"))


def negative_intensity(spark, d):
    value = se.negative_intensity(F.col("neg"), F.size("hits"))
    return rated(spark, d).select("ticket_id", F.round(value, 6).alias("intensity"))


def _priority():
    return tr.priority_score(
        F.size("hits"),
        se.negative_intensity(F.col("neg"), F.size("hits")),
        F.col("customer_plan"),
        F.col("confidence"),
    )


def priority_score(spark, d):
    return rated(spark, d).select("ticket_id", F.round(_priority(), 6).alias("score"))


def priority_level(spark, d):
    return rated(spark, d).select("ticket_id", tr.priority_level(_priority()).alias("level"))


def analyze_sentiment(spark, d):
    rows = se.analyze_sentiment(requests(spark, d))
    return _flat_sentiment(rows)


def analyze_by_join(spark, d):
    seed = po.seed_lexicon()
    entries = [
        *[(w, "valence", v) for w, v in seed.valence.items()],
        *[(w, "degree", v) for w, v in seed.degree.items()],
        *[(w, "negation", 1.0) for w in seed.negation],
    ]
    lexicon = spark.createDataFrame(entries, "token string, kind string, value double")
    return _flat_sentiment(se.analyze_sentiment_by_join(requests(spark, d), lexicon))


def _flat_sentiment(rows):
    return rows.select(
        "ticket_id",
        F.col("sentiment.label").alias("label"),
        F.col("sentiment.scores.neg").alias("neg"),
        F.col("sentiment.scores.neu").alias("neu"),
        F.col("sentiment.scores.pos").alias("pos"),
        F.round("sentiment.scores.compound", 6).alias("compound"),
        F.col("sentiment.scores.urgency_hits").alias("hits"),
        F.array_join("sentiment.urgency_signals", "|").alias("signals"),
    )


def custom_urgency(spark, d):
    rows = requests(spark, d).withColumn("signals", se.urgency_signals("text", CUSTOM))
    return rows.select("ticket_id", F.array_join("signals", "|").alias("signals"))


def route_ticket(spark, d):
    rows = lb.map_to_category(requests(spark, d)).select("ticket_id", "category")
    return tr.route_tickets(rows)


def flat(classified):
    return classified.select(
        "ticket_id",
        "category",
        "category_confidence",
        "sentiment",
        *[F.col(f"sentiment_scores.{c}").alias(c) for c in ("neg", "neu", "pos")],
        F.round("sentiment_scores.compound", 6).alias("compound"),
        "priority",
        "priority_score",
        "routed_to",
        F.array_join("urgency_signals", "|").alias("urgency_signals"),
    )


def classify_rules(spark, d):
    return flat(classify(requests(spark, d)))


def recent_tickets(spark, d):
    stamps = table(spark, d, "events").select(
        F.col("event_id").cast("string").alias("ticket_id"), F.col("ts").alias("created_at")
    )
    stamped = with_ticket_id(requests(spark, d)).join(stamps, "ticket_id")
    return recent_classified(stamped).select("ticket_id", "category", "priority", "created_at")


def ticket_stats(spark, d):
    return rp.ticket_stats(classify(requests(spark, d)))


def _classified_stamped(spark, d):
    """Classified tickets with their time; results are brought together with the times, never texts."""
    stamps = table(spark, d, "events").select(
        F.col("event_id").cast("string").alias("ticket_id"), F.col("ts").alias("created_at")
    )
    return classify(with_ticket_id(requests(spark, d))).join(stamps, "ticket_id", "left")


def prediction_store(spark, d):
    """A store of all classified tickets in three batches, one of them appended again and two of them gathered."""
    rows = _classified_stamped(spark, d)
    store = PredictionStore(spark, work_folder(spark, "store"), rows.schema)
    third = F.pmod(F.xxhash64("ticket_id"), F.lit(3))
    for i in (0, 1, 1):
        store.append(rows.where(third == i), f"batch {i}")
    store.compact()
    for i in (2, 0):
        store.append(rows.where(third == i), f"batch {i}")
    return store


def read_store(spark, d):
    return flat(prediction_store(spark, d).read())


def recent_from_store(spark, d):
    return prediction_store(spark, d).recent().select("ticket_id", "category", "priority", "created_at")


def stats_from_store(spark, d):
    return prediction_store(spark, d).stats()


def _ticket_stream(spark, d):
    documents = table(spark, d, "documents")
    # A stream reads folders: the table's own, or the one its single file lies in.
    name = "documents.parquet"
    whole = any(f"/{name}/" in f for f in documents.inputFiles())
    path, pattern = (f"{d}/{name}", None) if whole else (d, name)
    arriving = online.read_stream(spark, path, documents.schema, pattern=pattern)
    return fixtures.tickets(arriving).withColumn("text", tx.assemble_text("subject", "body"))


def stream_classify(spark, d):
    out, checkpoint = work_folder(spark, "online"), work_folder(spark, "online-progress")
    online.classify_stream(_ticket_stream(spark, d), out, checkpoint).awaitTermination()
    return flat(spark.read.parquet(out))


def stream_stats(spark, d):
    out, checkpoint = work_folder(spark, "stats"), work_folder(spark, "stats-progress")
    classified = classify(_ticket_stream(spark, d))
    online.stats_stream(classified, out, checkpoint).awaitTermination()
    return online.read_stats(spark, out)


# --- SQL --------------------------------------------------------------------------------------

POLES = ("neg", "neu", "pos", "compound")


def lexicon_sql() -> str:
    seed = po.seed_lexicon()
    words = dict.fromkeys([*seed.valence, *seed.degree, *seed.negation])
    rows = ", ".join(
        f"({q(w)}, {seed.valence.get(w, 'NULL')}, {seed.degree.get(w, 0.0)}, {w in seed.negation})"
        for w in words
    )
    return (
        "SELECT token, CAST(valence AS DOUBLE) AS valence, CAST(degree AS DOUBLE) AS degree, "
        f"negates FROM (VALUES {rows}) v(token, valence, degree, negates)"
    )


PUNCTUATION = q(string.punctuation)
PIECES = (
    "SELECT ticket_id, generate_subscripts(l, 1) AS pos_no, unnest(l) AS piece FROM ("
    f"SELECT ticket_id, {sql_words('text')} AS l FROM requests)"
)
TOKENS = (
    "SELECT ticket_id, pos_no, lower(w) AS word, upper(w) = w AND lower(w) <> w AS caps FROM ("
    f"SELECT *, CASE WHEN length(trim(piece, {PUNCTUATION})) <= 2 THEN piece "
    f"ELSE trim(piece, {PUNCTUATION}) END AS w FROM pieces)"
)
KNOWN = (
    "SELECT ticket_id, pos_no, word, caps, valence, coalesce(degree, 0) AS degree, "
    "coalesce(negates, false) OR contains(word, 'n''t') AS negates, "
    "bool_or(caps) OVER (PARTITION BY ticket_id) AND NOT bool_and(caps) "
    "OVER (PARTITION BY ticket_id) AS some_caps, "
    "min(CASE WHEN word = 'but' THEN pos_no END) OVER (PARTITION BY ticket_id) AS but_at, "
    "lead(word) OVER (PARTITION BY ticket_id ORDER BY pos_no) AS next_word "
    "FROM tokens LEFT JOIN lexicon ON token = word"
)
LOOKED_BACK = (
    "SELECT *, "
    + ", ".join(
        f"lag({c}, {n}) OVER w AS {c}{n}"
        for n in (1, 2, 3)
        for c in ("pos_no", "caps", "valence", "degree", "negates", "word")
    )
    + " FROM known WINDOW w AS (PARTITION BY ticket_id ORDER BY pos_no)"
)


def sql_step(v: str, n: int) -> str:
    scale = po.DISTANCE[n]
    sign = f"CASE WHEN {v} > 0 THEN {po.CAPITALS} ELSE -{po.CAPITALS} END"
    degree = f"CASE WHEN {v} < 0 THEN -degree{n} ELSE degree{n} END"
    loud = f"CASE WHEN caps{n} AND some_caps AND degree{n} <> 0 THEN {sign} ELSE 0 END"
    between = [f"word{k}" for k in range(1, n)]
    raised = " OR ".join(f"{w} IN ({names(po.NEVER_BEFORE)})" for w in between) or "false"
    assured = " OR ".join(f"{w} = 'doubt'" for w in between) or "false"
    damped = "".join(
        f" + CASE WHEN word{k + 1} IN ({names(po.DAMPING)}) AND word{k} = 'of' "
        f"THEN CAST({po.DAMPED} AS DOUBLE) ELSE 0 END"
        for k in ((1, 2) if n == 3 else ())
    )
    return (
        f"CASE WHEN pos_no{n} IS NOT NULL AND valence{n} IS NULL THEN "
        f"({v} + ({degree} + {loud}) * CAST({scale} AS DOUBLE)) * "
        f"CASE WHEN word{n} = 'never' AND ({raised}) THEN CAST({po.RAISED} AS DOUBLE) "
        f"WHEN word{n} = 'without' AND ({assured}) THEN 1 "
        f"WHEN negates{n} THEN CAST({po.NEGATION} AS DOUBLE) ELSE 1 END{damped} ELSE {v} END"
    )


VALUED = (
    f"SELECT ticket_id, pos_no, CASE WHEN valence IS NULL OR degree <> 0 "
    f"OR (word IN ({names(po.DAMPING)}) AND coalesce(next_word, '') = 'of') THEN 0 ELSE v3 * "
    f"CASE WHEN word1 = 'least' AND valence1 IS NULL AND coalesce(word2, '') NOT IN ({names(po.LEAST_AFTER)}) "
    f"THEN CAST({po.NEGATION} AS DOUBLE) ELSE 1 END * "
    f"CASE WHEN pos_no < but_at THEN {po.BEFORE_BUT} WHEN pos_no > but_at THEN {po.AFTER_BUT} ELSE 1 END "
    f"END AS v FROM (SELECT *, {sql_step('v2', 3)} AS v3 FROM ("
    f"SELECT *, {sql_step('v1', 2)} AS v2 FROM (SELECT *, {sql_step('v0', 1)} AS v1 FROM ("
    f"SELECT *, valence + CASE WHEN caps AND some_caps THEN CASE WHEN valence > 0 "
    f"THEN CAST({po.CAPITALS} AS DOUBLE) ELSE CAST(-{po.CAPITALS} AS DOUBLE) END ELSE 0 END AS v0 "
    "FROM looked_back))))"
)
SUMS = (
    "SELECT ticket_id, sum(v ORDER BY pos_no) AS total, "
    "sum(CASE WHEN v > 0 THEN v + 1 ELSE 0 END ORDER BY pos_no) AS up, "
    "-sum(CASE WHEN v < 0 THEN v - 1 ELSE 0 END ORDER BY pos_no) AS down, "
    "count(*) FILTER (v = 0) AS flat FROM valued GROUP BY ticket_id"
)
MARKED = (
    "SELECT ticket_id, least(length(text) - length(replace(text, '!', '')), 4) * "
    f"CAST({po.EXCLAMATION} AS DOUBLE) + CASE WHEN asks <= 1 THEN 0 WHEN asks <= 3 "
    f"THEN asks * CAST({po.QUESTION} AS DOUBLE) ELSE {po.MANY_QUESTIONS} END AS extra "
    "FROM (SELECT *, length(text) - length(replace(text, '?', '')) AS asks FROM requests)"
)
POLARITY = (
    "SELECT ticket_id, "
    "coalesce(round(down / nullif(up + down + flat, 0), 3), 0) AS neg, "
    "coalesce(round(flat / nullif(up + down + flat, 0), 3), 0) AS neu, "
    "coalesce(round(up / nullif(up + down + flat, 0), 3), 0) AS pos, "
    "round(greatest(-1, least(1, total / sqrt(total * total + 15))), 4) AS compound FROM ("
    "SELECT ticket_id, total + sign(total) * extra AS total, "
    "up + CASE WHEN up > down THEN extra ELSE 0 END AS up, "
    "down + CASE WHEN up < down THEN extra ELSE 0 END AS down, flat FROM ("
    "SELECT ticket_id, extra, coalesce(total, 0) AS total, coalesce(up, 0) AS up, "
    "coalesce(down, 0) AS down, coalesce(flat, 0) AS flat "
    "FROM marked LEFT JOIN sums USING (ticket_id)))"
)
POLARITY_STEPS = {
    "lexicon": lexicon_sql(),
    "pieces": PIECES,
    "tokens": TOKENS,
    "known": KNOWN,
    "looked_back": LOOKED_BACK,
    "valued": VALUED,
    "sums": SUMS,
    "marked": MARKED,
    "polarity": POLARITY,
}


def sql_hits(text: str, phrases) -> str:
    entries = ", ".join(f"{{'p': {q(p)}, 'd': CAST({x} AS DOUBLE)}}" for p, x in phrases)
    return f"list_filter([{entries}], lambda h: contains(lower({text}), h.p))"


def sql_signals(hits: str) -> str:
    return f"coalesce(array_to_string(list_transform({hits}, lambda h: h.p), '|'), '')"


def sql_boost(compound: str, hits: str) -> str:
    total = f"coalesce(list_sum(list_transform({hits}, lambda h: h.d)), 0)"
    return (
        f"greatest(CAST(-1 AS DOUBLE), least(CAST(1 AS DOUBLE), {compound} + "
        f"greatest(CAST(-0.6 AS DOUBLE), least(CAST(0.6 AS DOUBLE), {total}))))"
    )


def sql_label(compound: str, neg: str, hits: str) -> str:
    return (
        f"CASE WHEN {compound} < CAST(-0.5 AS DOUBLE) OR ({hits} >= 2 AND "
        f"{neg} >= CAST(0.35 AS DOUBLE)) THEN 'Angry' "
        f"WHEN {compound} < CAST(-0.05 AS DOUBLE) THEN 'Frustrated' "
        f"WHEN {compound} >= CAST(0.2 AS DOUBLE) THEN 'Positive' ELSE 'Neutral' END"
    )


def sql_intensity(neg: str, hits: str) -> str:
    bonus = f"least(CAST(0.1 AS DOUBLE) * {hits}, CAST(0.3 AS DOUBLE))"
    return f"greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), {neg} + {bonus}))"


def sql_priority(hits: str, intensity: str, plan: str, confidence: str) -> str:
    weights = " ".join(f"WHEN {q(p)} THEN CAST({w} AS DOUBLE)" for p, w in fv.PLAN_WEIGHTS.items())
    return (
        "greatest(CAST(0 AS DOUBLE), least(CAST(100 AS DOUBLE), CAST(40 AS DOUBLE) * "
        f"least({hits}, 1) + CAST(30 AS DOUBLE) * {intensity} + CAST(20 AS DOUBLE) * "
        f"CASE {plan} {weights} ELSE 0 END + CAST(10 AS DOUBLE) * {confidence}))"
    )


def sql_level(score: str) -> str:
    return f"CASE WHEN {score} >= 70 THEN 'P1' WHEN {score} >= 40 THEN 'P2' ELSE 'P3' END"


def sql_team(category: str) -> str:
    whens = " ".join(f"WHEN {q(c)} THEN {q(t)}" for c, t in fv.TEAM_OF_CATEGORY.items())
    return f"CASE {category} {whens} ELSE {q(fv.DEFAULT_TEAM)} END"


RATED = (
    f"SELECT r.ticket_id, r.customer_plan, {sql_hits('r.text', fv.URGENCY_PHRASES)} AS hits, "
    "p.compound, p.neg, CAST(CASE WHEN m.category IS NULL THEN 0 ELSE 1 END AS DOUBLE) AS confidence "
    "FROM requests r JOIN polarity p USING (ticket_id) JOIN mapped m USING (ticket_id)"
)
SCORE = sql_priority("len(hits)", sql_intensity("neg", "len(hits)"), "customer_plan", "confidence")
ANALYZED = (
    "SELECT *, " + sql_label("compound", "neg", "hits") + " AS label FROM ("
    "SELECT r.* EXCLUDE (priority), CASE WHEN filled THEN p.neg ELSE 0 END AS neg, "
    "CASE WHEN filled THEN p.neu ELSE 1 END AS neu, CASE WHEN filled THEN p.pos ELSE 0 END AS pos, "
    f"CASE WHEN filled THEN {sql_boost('p.compound', 'found')} ELSE 0 END AS compound, "
    f"CAST(len(found) AS INTEGER) AS hits, {sql_signals('found')} AS signals FROM ("
    f"SELECT *, length(text) > 0 AS filled, {sql_hits('text', fv.URGENCY_PHRASES)} AS found "
    "FROM requests) r JOIN polarity p USING (ticket_id))"
)
CLASSIFIED = (
    "SELECT *, " + sql_level("score") + " AS priority, CAST(round(score) AS INTEGER) AS "
    "priority_score, " + sql_team("category") + " AS routed_to FROM (SELECT *, "
    + sql_priority("hits", sql_intensity("neg", "hits"), "customer_plan", "sure")
    + " AS score FROM (SELECT a.*, m.category, CAST(CASE WHEN m.category IS NULL THEN 0 ELSE 1 END "
    "AS DOUBLE) AS sure FROM analyzed a JOIN mapped m USING (ticket_id) "
    f"WHERE length(text) >= 1 AND a.customer_plan IN ({names(fv.PLANS)})))"
)


def analyzed_sql(body, **extra):
    return with_ctes(body, "requests", "mapped", **POLARITY_STEPS, analyzed=ANALYZED, **extra)


FLAT = analyzed_sql(
    "SELECT CAST(ticket_id AS VARCHAR) AS ticket_id, category, sure AS category_confidence, "
    "label AS sentiment, neg, neu, pos, round(compound, 6) AS compound, priority, "
    "priority_score, routed_to, signals AS urgency_signals FROM classified",
    classified=CLASSIFIED,
)
FLAT_SENTIMENT = analyzed_sql(
    "SELECT ticket_id, label, neg, neu, pos, round(compound, 6) AS compound, hits, signals "
    "FROM analyzed"
)
STATS = analyzed_sql(
    " UNION ALL ".join(
        f"SELECT '{dim}' AS dimension, {col} AS value, count(*) AS n FROM classified "
        f"WHERE {col} IS NOT NULL GROUP BY {col}"
        for dim, col in (
            ("category", "category"),
            ("sentiment", "label"),
            ("priority", "priority"),
            ("routed_to", "routed_to"),
        )
    ),
    classified=CLASSIFIED,
)


def rated_sql(expression, name):
    return with_ctes(
        f"SELECT ticket_id, {expression} AS {name} FROM rated",
        "requests",
        "mapped",
        **POLARITY_STEPS,
        rated=RATED,
    )


TURNS = (
    "SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS ticket_id, text "
    "FROM conversations WHERE role = 'user'"
)

QUERIES = {
    "clean_conversations": (
        clean_conversations,
        f"SELECT ticket_id, {sql_clean('text')} AS out FROM ({TURNS})",
    ),
    "conversation_polarity": (
        conversation_polarity,
        with_ctes(
            "SELECT ticket_id, neg, neu, pos, compound FROM polarity", requests=TURNS, **POLARITY_STEPS
        ),
    ),
    "lexicon_polarity": (
        lexicon_polarity,
        with_ctes(
            "SELECT ticket_id, neg, neu, pos, compound FROM polarity", "requests", **POLARITY_STEPS
        ),
    ),
    "urgency_signals": (
        urgency_signals,
        with_ctes(
            f"SELECT ticket_id, {sql_signals('found')} AS signals, CAST(len(found) AS INTEGER) "
            f"AS hits FROM (SELECT ticket_id, {sql_hits('text', fv.URGENCY_PHRASES)} AS found "
            "FROM requests)",
            "requests",
        ),
    ),
    "boost_compound": (
        boost_compound,
        rated_sql(f"round({sql_boost('compound', 'hits')}, 6)", "compound"),
    ),
    "sentiment_label": (
        sentiment_label,
        rated_sql(sql_label("compound", "neg", "len(hits)"), "label"),
    ),
    "negative_intensity": (
        negative_intensity,
        rated_sql(f"round({sql_intensity('neg', 'len(hits)')}, 6)", "intensity"),
    ),
    "analyze_sentiment": (analyze_sentiment, FLAT_SENTIMENT),
    "analyze_sentiment_by_join": (analyze_by_join, FLAT_SENTIMENT),
    "custom_urgency": (
        custom_urgency,
        with_ctes(
            f"SELECT ticket_id, {sql_signals(sql_hits('text', CUSTOM.items()))} AS signals "
            "FROM requests",
            "requests",
        ),
    ),
    "priority_score": (priority_score, rated_sql(f"round({SCORE}, 6)", "score")),
    "priority_level": (priority_level, rated_sql(sql_level(SCORE), "level")),
    "route_ticket": (
        route_ticket,
        with_ctes(f"SELECT ticket_id, category, {sql_team('category')} AS routed_to FROM mapped", "mapped"),
    ),
    "classify_rules": (classify_rules, FLAT),
    "recent_tickets": (
        recent_tickets,
        analyzed_sql(
            "SELECT CAST(ticket_id AS VARCHAR) AS ticket_id, category, priority, ts AS created_at "
            "FROM classified JOIN events ON event_id = ticket_id "
            "ORDER BY ts DESC, CAST(ticket_id AS VARCHAR) LIMIT 20",
            classified=CLASSIFIED,
        ),
    ),
    "ticket_stats": (ticket_stats, STATS),
    "read_store": (read_store, FLAT),
    "recent_from_store": (
        recent_from_store,
        analyzed_sql(
            "SELECT CAST(ticket_id AS VARCHAR) AS ticket_id, category, priority, ts AS created_at "
            "FROM classified LEFT JOIN events ON event_id = ticket_id "
            "ORDER BY ts DESC NULLS LAST, CAST(ticket_id AS VARCHAR) LIMIT 20",
            classified=CLASSIFIED,
        ),
    ),
    "stats_from_store": (stats_from_store, STATS),
    "stream_classify": (stream_classify, FLAT),
    "stream_stats": (stream_stats, STATS),
}
