"""Independent SQL of the conversation repair: a forward search that carries the best edits of each state."""

from __future__ import annotations


def _best(*options: str) -> str:
    """The cheapest of some paths; of equals the one with the least letters."""
    return f"list_min([{', '.join(o for o in options if o)}])"


def _add(path: str, letter: str, cost: str, row: str | None = None) -> str:
    """A path with one more edit, and with one more row of the repaired conversation."""
    text = f"{path}.t || CASE WHEN {path}.t = '' THEN '' ELSE chr(10) END || {row}" if row else f"{path}.t"
    return f"{{'c': {path}.c + {cost}, 'a': {path}.a || '{letter}', 't': {text}}}"


def _if(test: str, path: str) -> str:
    return f"CASE WHEN {test} THEN {path} END"


def _inserted(source: str) -> str:
    """The states e, s, o, c of ``source`` after insertions."""
    fill = lambda path, role: _add(path, "I", "2", f"'{role}:'")
    first = _best(f"{source}.o", *[fill(f"{source}.{x}", "user") for x in "esc"])
    return f"""
        SELECT * REPLACE ({_best("w.o", fill("w.c", "user"))} AS o) FROM (
            SELECT * REPLACE ({_best("v.c", fill("v.o", "assistant"))} AS c)
            FROM (SELECT * REPLACE ({first} AS o) FROM {source}) v
        ) w"""


def repair_sql() -> str:
    rerole = lambda path, role: _add(path, "R", "2 + r.late", f"'{role}:' || r.text")
    keep = lambda path: _add(path, "K", "r.late", "r.role || ':' || r.text")
    stay = "NOT r.doomed"
    before_user = _best("p.e", "p.s", "p.c")
    far = "{'c': 1000000::BIGINT, 'a': '', 't': ''}"
    zero = "{'c': 0::BIGINT, 'a': '', 't': ''}"
    return rf"""
        WITH RECURSIVE keyed AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k
            FROM conversations
        ), crc AS (
            SELECT *, xor(4294967295, list_reduce(
                list_prepend(4294967295, list_transform(string_split(k, ''), lambda x: unicode(x)::BIGINT)),
                lambda c, x: list_reduce(
                    list_prepend(xor(c, x), range(8)),
                    lambda d, i: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END
                )
            )) % 20 AS harm
            FROM keyed
        ), damaged AS (
            SELECT conv_id, turn, CASE harm WHEN 4 THEN 'user' ELSE role END AS role,
                   CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(range(CASE harm WHEN 3 THEN 2 ELSE 1 END)) AS copy
            FROM crc WHERE harm <> 0
        ), placed AS (
            SELECT *, row_number() OVER (
                PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy
            ) AS i
            FROM damaged
        ), judged AS (
            SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
                   row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS repeated,
                   NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut,
                   lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair
            FROM placed
        ), r AS (
            SELECT *, blank OR repeated AS doomed, (cut AND NOT blank AND NOT repeated)::INT AS late FROM judged
        ), p AS (
            SELECT conv_id, 1 AS i, {zero} AS e, {far} AS s, {far} AS o, {far} AS c
            FROM (SELECT DISTINCT conv_id FROM r)
            UNION ALL
            SELECT p.conv_id, p.i + 1, {_add("p.e", "D", "3")},
                   {_best(_add("p.s", "D", "3"), _if(f"{stay} AND left(r.role, 1) = 's'", keep("p.e")))},
                   {_best(
                       _add("p.o", "D", "3"),
                       _if(f"{stay} AND left(r.role, 1) = 'u'", keep("p.before_user")),
                       _if(stay, rerole("p.before_user", "user")),
                   )},
                   {_best(
                       _add("p.c", "D", "3"),
                       _if(f"{stay} AND left(r.role, 1) = 'a'", keep("p.o")),
                       _if(stay, rerole("p.o", "assistant")),
                   )}
            FROM (SELECT *, {before_user} AS before_user FROM ({_inserted("p")}) p) p
            JOIN r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i
        ), ends AS (
            SELECT * FROM p
            WHERE (conv_id, i) IN (SELECT (conv_id, 1 + max(i)) FROM r GROUP BY conv_id)
        ), done AS (
            SELECT conv_id, {_best("z.e", "z.c")} AS best FROM ({_inserted("ends")}) z
        ), faults AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                   count(*) FILTER (blank) AS blank,
                   count(*) FILTER (repeated AND NOT blank) AS duplicate,
                   sum(late) AS truncated,
                   count(*) FILTER (i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal
            FROM r GROUP BY conv_id
        )
        SELECT k.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank,
               coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
               coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit,
               sha256(coalesce(best.t, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) k
        LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM k.conv_id
        LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM k.conv_id
    """
