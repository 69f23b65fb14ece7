"""A ticket table derived from the ``documents`` table, for tests and checks.

The text is one projection that reads alike in Spark SQL and DuckDB. It adds the
ticket columns the documents lack and puts a rule-bearing subject before each
document's own text.
"""

TICKETS_SQL = """
SELECT
  doc_id AS ticket_id,
  CASE doc_id % 13
    WHEN 0 THEN 'Charged twice, this is UNACCEPTABLE'
    WHEN 1 THEN 'I forgot my password and cannot log in'
    WHEN 2 THEN 'App crashes with error code 7, urgent, fix asap'
    WHEN 3 THEN 'Please add dark mode, would be great if you could'
    WHEN 4 THEN 'How do I install the docker image'
    WHEN 5 THEN 'I love the new dashboard, thank you so much!'
    WHEN 6 THEN 'We want to integrate'
    WHEN 7 THEN '<b>Refund</b> me, see https://shop.example.com/r?id=1 or mail a.b@shop.example.com'
    WHEN 8 THEN 'Total scam and fraud, lawsuit next, I am furious'
    WHEN 9 THEN '   '
    WHEN 10 THEN CAST(NULL AS STRING)
    WHEN 11 THEN 'I was double charged and am switching to a competitor'
    ELSE 'Hello team, a bit disappointed with the recent changes' END AS subject,
  CASE WHEN doc_id % 17 = 0 THEN CAST(NULL AS STRING) ELSE text END AS body,
  CASE doc_id % 9
    WHEN 0 THEN 'Billing and Payments' WHEN 1 THEN 'billing and payments'
    WHEN 2 THEN 'IT Support' WHEN 3 THEN 'Technical Support'
    WHEN 4 THEN 'Customer Service' WHEN 5 THEN CAST(NULL AS STRING)
    ELSE 'Product Support' END AS queue,
  CASE doc_id % 4 WHEN 0 THEN 'Incident' WHEN 1 THEN 'Request'
    WHEN 2 THEN 'Problem' ELSE 'Change' END AS type,
  CASE doc_id % 7 WHEN 0 THEN 'medium' WHEN 1 THEN 'high' WHEN 2 THEN 'high'
    WHEN 3 THEN 'low' WHEN 4 THEN 'critical' ELSE 'medium' END AS priority,
  CASE doc_id % 11
    WHEN 0 THEN ' Login ' WHEN 1 THEN 'Bug' WHEN 2 THEN 'Feature'
    WHEN 3 THEN 'Documentation' WHEN 4 THEN 'Payment' WHEN 5 THEN ''
    WHEN 6 THEN CAST(NULL AS STRING) ELSE 'Feedback' END AS tag_1,
  CASE WHEN doc_id % 10 = 0 THEN 'Outage' ELSE CAST(NULL AS STRING) END AS tag_2,
  CAST(NULL AS STRING) AS tag_3,
  CASE WHEN doc_id % 12 = 0 THEN 'bulk' ELSE '' END AS tag_4,
  lang AS language,
  CASE doc_id % 5 WHEN 3 THEN 'pro' WHEN 4 THEN 'enterprise' ELSE 'free' END AS customer_plan
FROM {documents}
"""


def tickets(documents):
    """The derived ticket table, as a projection of the ``documents`` DataFrame."""
    return documents.sparkSession.sql(
        TICKETS_SQL.format(documents="{documents}"), documents=documents
    )
