"""All registered queries by name: a function of (spark, folder) and a SQL text."""

from queries import evaluations, profiles, texts, topics, triage_queries

REGISTRY = {
    **texts.QUERIES,
    **profiles.QUERIES,
    **evaluations.QUERIES,
    **topics.QUERIES,
    **triage_queries.QUERIES,
}
