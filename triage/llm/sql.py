"""DuckDB texts of the operators that SQL can express."""

from __future__ import annotations

import math

from triage.llm import licenses

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _base32(hex_digest: str) -> str:
    """Base32 of 40 hexadecimal digits, five at a time."""
    out = []
    for i in range(8):
        value = f"CAST('0x' || substr({hex_digest}, {1 + 5 * i}, 5) AS BIGINT)"
        out += [f"substr('{ALPHABET}', CAST((({value} >> {s}) & 31) + 1 AS BIGINT), 1)" for s in (15, 10, 5, 0)]
    return " || ".join(out)


WARC = (
    "WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS x FROM pages), "
    "f AS (SELECT *, min(page_id) OVER (PARTITION BY x) AS first FROM d) "
    f"SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {_base32('x')} AS payload_digest, "
    "CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, "
    "CASE WHEN page_id <> first THEN first END AS refers_to FROM f"
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> str:
    return rf"regexp_extract_all(translate({text}, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _places(phrase: str) -> str:
    same = " AND ".join(f"w[i + {k}] = {_quoted(x)}" for k, x in enumerate(phrase.split()))
    return f"list_filter(range(1, len(w) + 1), lambda i: {same})"


def _licenses() -> str:
    found = ", ".join(f"{_places(p)} AS p{i}" for i, p in enumerate(licenses.PHRASES))
    n = len(licenses.PHRASES)
    every = "list_concat(" * (n - 1) + "p0" + "".join(f", p{i})" for i in range(1, n))
    base = ", ".join(
        f"CASE WHEN len(p{i}) > 0 THEN {_quoted(x)} END" for i, x in enumerate(licenses.PHRASES.values())
    )
    templates = []
    for label, text in licenses.TEMPLATES.items():
        own = sorted(set(licenses.words_of(text)))
        need = max(1, math.ceil(0.8 * len(own) - 1e-9))
        room = math.ceil(len(licenses.words_of(text)) / 0.8 - 1e-9)
        templates.append(f"({_quoted(label)}, [{', '.join(map(_quoted, own))}], {need}, {room})")
    labels = "array_to_string(list_sort(list_distinct(list_filter({}, lambda x: x IS NOT NULL))), ',')"
    return (
        "WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents), "
        f"words AS (SELECT r, doc_id, {_words('text')} AS w FROM texts), "
        f"phrases AS (SELECT r, doc_id, len(w) AS n, {found} FROM words), "
        f"base AS (SELECT r, doc_id, n, {every} AS starts, [{base}] AS names FROM phrases), "
        f"blocks AS (SELECT r, list_distinct({_words('line')}) AS b FROM "
        "(SELECT r, unnest(string_split(text, chr(10))) AS line FROM texts)), "
        f"templates(label, t, need, room) AS (VALUES {', '.join(templates)}), "
        "lines AS (SELECT r, label, len(list_intersect(b, t)) / len(t) AS share FROM blocks, templates "
        "WHERE len(list_intersect(b, t)) >= need), "
        # Windows of so many words as the template takes, over line ends, from each word of the template on.
        "places AS (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS i FROM words), "
        "own AS (SELECT r, label, i, word, room, need, len(t) AS size FROM places "
        "JOIN (SELECT *, unnest(t) AS word FROM templates) USING (word)), "
        "windows AS (SELECT a.r, a.label, a.i, count(DISTINCT b.word) / any_value(a.size) AS share FROM own a "
        "JOIN own b ON a.r = b.r AND a.label = b.label AND b.i BETWEEN a.i AND a.i + a.room - 1 "
        "GROUP BY a.r, a.label, a.i HAVING count(DISTINCT b.word) >= any_value(a.need)), "
        "hits AS (SELECT r, label, share FROM lines UNION ALL SELECT r, label, share FROM windows), "
        "best AS (SELECT r, list(label) AS found, max(share) AS share FROM hits GROUP BY r) "
        "SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(len(starts) AS BIGINT) AS n_base, "
        "CAST(list_min(starts) - 1 AS BIGINT) AS first_word, CAST(list_max(starts) - 1 AS BIGINT) AS last_word, "
        f"{labels.format('names')} AS base_labels, "
        f"{labels.format('list_concat(names, coalesce(found, []))')} AS labels, "
        "CASE WHEN len(starts) > 0 THEN CAST(1 AS DOUBLE) ELSE coalesce(share, CAST(0 AS DOUBLE)) END AS score "
        "FROM base LEFT JOIN best USING (r)"
    )


LICENSES = _licenses()


def _line_runs(min_words: int = 10) -> str:
    """Runs by their text: the shortest sufficient ones read forward and backward from every line."""
    line = r"trim(regexp_replace(x, '[\x09-\x0D]', ' ', 'g'))"
    return (
        "WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS own FROM documents WHERE text IS NOT NULL), "
        f"n AS (SELECT doc_id, own, list_transform(own, lambda x: {line}) AS l, "
        r"list_transform(own, lambda x: len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))) AS w FROM t), "
        "c AS (SELECT *, list_transform(range(1, len(l) + 1), lambda i: list_sum(w[1:i])) AS cum FROM n), "
        "p AS (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM c), "
        "r AS (SELECT doc_id, l, i, "
        f"list_min(list_filter(range(1, len(l) + 1), lambda e: e >= i AND cum[e] - cum[i] + w[i] >= {min_words})) AS e, "
        f"list_max(list_filter(range(1, len(l) + 1), lambda b: b <= i AND cum[i] - cum[b] + w[b] >= {min_words})) AS b "
        "FROM p), "
        "runs AS (SELECT 1 AS kind, doc_id, i AS s, e, array_to_string(l[i:e], chr(10)) AS run FROM r WHERE e IS NOT NULL "
        "UNION ALL SELECT 2, doc_id, b, i, array_to_string(l[b:i], chr(10)) FROM r WHERE b IS NOT NULL), "
        "later AS (SELECT doc_id, s, e FROM (SELECT *, row_number() OVER (PARTITION BY kind, run ORDER BY doc_id, s) AS k "
        "FROM runs) WHERE k > 1), "
        "gone AS (SELECT doc_id, list(DISTINCT i) AS g FROM (SELECT doc_id, unnest(range(s, e + 1)) AS i FROM later) "
        "GROUP BY doc_id) "
        "SELECT doc_id, CASE WHEN g IS NULL THEN text ELSE array_to_string(list_transform(list_filter("
        "range(1, len(own) + 1), lambda i: NOT list_contains(g, i)), lambda i: own[i]), chr(10)) END AS text, "
        "CAST(coalesce(len(own), 0) AS INTEGER) AS n_lines, CAST(coalesce(len(g), 0) AS INTEGER) AS n_removed "
        "FROM documents LEFT JOIN t USING (doc_id) LEFT JOIN gone USING (doc_id)"
    )


LINE_RUNS = _line_runs()


def _ranked_search(most: int = 20) -> str:
    """Every document scored for every item, without lists or bounds."""
    words = rf"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return (
        f"WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents), "
        "n AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n FROM d WHERE len(w) > 0), "
        "a AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n), "
        "tf AS (SELECT r, t, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY r, t), "
        "df AS (SELECT t, CAST(count(*) AS BIGINT) AS df FROM tf GROUP BY t), "
        f"q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest({words}) AS t FROM "
        "(SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY item_id, t), "
        "qw AS (SELECT item_id, t, times * CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w "
        "FROM q JOIN df USING (t), a), "
        "m AS (SELECT r, doc_id, 100 - 25 + ((25 * n * docs) // terms) AS m FROM n, a), "
        "s AS (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score "
        "FROM qw JOIN tf USING (t) JOIN m USING (r) GROUP BY item_id, r, doc_id), "
        "k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM s "
        "WHERE score > 0) "
        f"SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= {most}"
    )


RANKED_SEARCH = _ranked_search()
