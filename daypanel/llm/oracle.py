"""SQL of another engine for the queries that SQL can express."""

from __future__ import annotations

from daypanel.llm import licences
from daypanel.llm.chat import INSTRUCT
from daypanel.llm.quality_rules import FUNCTION_WORDS


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


EXACT_DEDUP = """
    WITH t AS (
        SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
        FROM documents
    )
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, text_sha256
    FROM t WINDOW same AS (PARTITION BY text_sha256)
"""


def _chat() -> str:
    t = INSTRUCT
    marks = "".join(f" + (length(text) - length(replace(text, {_text(c)}, ''))) // {len(c)}" for c in ("\\", *t.control))
    around = "".join(f" WHEN {_text(role)} THEN {len(turn.before) + len(turn.after)}" for role, turn in t.turns)
    pairs = ", ".join(f"({_text(a)}, {_text(b)})" for a, b in t.order)
    last = ", ".join(map(_text, t.last))
    return f"""
    WITH c AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
    ), o AS (
        SELECT *, (lag(role, 1, '') OVER w, role) IN ({pairs}) AS follows, row_number() OVER w = count(*) OVER (PARTITION BY conv_id) AS ends
        FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
    )
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           sum(length(text){marks} + CASE role{around} END)::BIGINT AS formatted_chars,
           bool_and(follows) AND bool_or(ends AND role IN ({last})) AS valid
    FROM o GROUP BY conv_id
    """


def _canonical(text: str) -> str:
    out = f"regexp_replace(lower({text}), {_text(licences.COPYRIGHT_LINE)}, chr(10), 'g')"
    for pattern, plain in licences.EQUIVALENT:
        out = f"regexp_replace({out}, {_text(pattern)}, {_text(plain)}, 'g')"
    return f"trim(regexp_replace(regexp_replace({out}, '[^a-z0-9\\n]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g'), ' ' || chr(10))"


def _licences() -> str:
    """Each known text is looked for in every text, as a regular expression of its words."""
    known = ", ".join(f"({_text(name)}, {_text(body)})" for name, body in licences.KNOWN)
    headings = ", ".join(f"({_text(name)}, {_text(heading)})" for name, heading in licences.HEADINGS)
    return f"""
    WITH known AS (SELECT DISTINCT licence, replace({_canonical("body")}, chr(10), ' ') AS form FROM (VALUES {known}) v(licence, body)),
    d AS (SELECT row_number() OVER () AS r, doc_id, {_canonical("coalesce(text, '')")} AS t FROM documents),
    found AS (
        SELECT r, form, list(licence) AS names, any_value(len(regexp_extract_all(
            chr(10) || replace(t, chr(10), chr(10) || chr(10)) || chr(10), chr(10) || replace(form, ' ', '(?: |\\n\\n)') || chr(10)))) AS n
        FROM d JOIN known ON contains(replace(t, chr(10), ' '), form) GROUP BY r, form
    ),
    hit AS (SELECT r, list_distinct(flatten(list(names))) AS names, sum(n)::BIGINT AS n FROM found WHERE n > 0 GROUP BY r),
    entire AS (
        SELECT form, min(licence) AS licence FROM (
            SELECT licence, form FROM known
            UNION ALL SELECT licence, replace({_canonical("heading")}, chr(10), ' ') || ' ' || form FROM known JOIN (VALUES {headings}) h(licence, heading) USING (licence)
            WHERE length(form) > 200
        ) GROUP BY form
    )
    SELECT doc_id, entire.licence AS whole_licence, coalesce(n, 0) AS n_notices,
           array_to_string(list_sort(list_distinct(list_concat(coalesce(names, []), CASE WHEN entire.licence IS NULL THEN [] ELSE [entire.licence] END))), ',') AS licences
    FROM d LEFT JOIN hit USING (r) LEFT JOIN entire ON replace(d.t, chr(10), ' ') = entire.form
    """


FILL_IN_MIDDLE = """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(t) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
    h AS (SELECT doc_id, t, n, [('0x' || substr(s, 8 * k + 1, 8))::BIGINT FOR k IN range(4)] AS h FROM d),
    c AS (
        SELECT doc_id, t, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
               CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
                    WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
        FROM h
    ),
    p AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM c)
    SELECT doc_id, n, form, CASE form WHEN 'plain' THEN NULL ELSE a END AS prefix_chars, CASE form WHEN 'plain' THEN NULL ELSE b - a END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                            ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
           sha256(t) AS restored_sha256
    FROM p
"""


def _vector_codes(rounds: int = 4) -> str:
    ctes = [
        """k AS MATERIALIZED (
            SELECT row_number() OVER () AS r, vec_id, label, embedding, len(embedding) // 4 AS w FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        """p AS MATERIALIZED (
            SELECT r, i // w AS part, i % w AS pos, floor(1024 * embedding[i + 1]::DOUBLE)::BIGINT AS x
            FROM (SELECT *, unnest(range(len(embedding))) AS i FROM k))""",
        """b0 AS MATERIALIZED (
            SELECT part, entry, pos, x FROM p JOIN (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k ORDER BY vec_id LIMIT 256) USING (r))""",
    ]
    for t in range(rounds + 1):
        ctes.append(f"""a{t} AS MATERIALIZED (
            SELECT r, part, min({{'d': d, 'e': entry}}) AS best
            FROM (SELECT p.r, part, b.entry, sum((p.x - b.x) * (p.x - b.x))::BIGINT AS d FROM p JOIN b{t} b USING (part, pos) GROUP BY ALL) GROUP BY ALL)""")
        if t < rounds:
            ctes.append(f"""b{t + 1} AS MATERIALIZED (
                SELECT part, entry, pos, coalesce(m, b.x) AS x FROM b{t} b LEFT JOIN (
                    SELECT part, best.e AS entry, pos, floor(sum(x)::DOUBLE / count(*))::BIGINT AS m FROM p JOIN a{t} USING (r, part) GROUP BY ALL
                ) USING (part, entry, pos))""")
    return f"""
    WITH {", ".join(ctes)},
    c AS (SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM a{rounds} GROUP BY r)
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
           (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, pos)) FROM b{rounds}) AS codebooks_sha256
    FROM k JOIN c USING (r)
    """


#: the rules' bad and good cases, written for this engine
VOTES = (
    ("n_words < 20", "n_words >= 50"),
    ("100 * n_repeat_words > 30 * n_words", "n_words >= 20 AND 100 * n_repeat_words <= 5 * n_words"),
    ("10 * n_dup_lines > 3 * n_lines", "n_lines > 1 AND n_dup_lines = 0"),
    ("10 * n_symbols > n_words", "n_words > 0 AND 100 * n_symbols <= n_words"),
    ("n_words > 0 AND (word_chars < 3 * n_words OR word_chars > 10 * n_words)", "word_chars BETWEEN 4 * n_words AND 8 * n_words"),
    ("n_letters >= 50 AND 10 * n_upper > 4 * n_letters", "n_letters >= 50 AND 10 * n_upper < n_letters"),
    ("100 * n_letters < 80 * word_chars", "n_words > 0 AND 100 * n_letters >= 90 * word_chars"),
    ("n_words >= 50 AND 100 * n_function < n_words", "n_words > 0 AND 100 * n_function >= 8 * n_words"),
    ("n_words >= 50 AND n_distinct * n_distinct < 4 * n_words", "n_words >= 50 AND n_distinct * n_distinct > 20 * n_words"),
    ("10 * n_exclamations > 3 * n_words", "n_words > 0 AND 100 * n_exclamations <= 5 * n_words"),
    ("10 * n_lone > n_words", "n_words > 0 AND 100 * n_lone <= 2 * n_words"),
    ("n_words >= 50 AND (n_ends = 0 OR 2 * n_ends > n_words)", "n_ends > 0 AND 100 * n_ends BETWEEN n_words AND 35 * n_words"),
)


def _quality_rules(rounds: int = 30) -> str:
    votes = " || ".join(f"CASE WHEN {bad} THEN 'b' WHEN {good} THEN 'g' ELSE '-' END" for bad, good in VOTES)
    space, known = "[ \\t-\\r]+", ", ".join(map(_text, FUNCTION_WORDS))
    belief = []
    for t in range(rounds):
        belief.append(f"""e{t} AS MATERIALIZED (
            SELECT votes, any_value(n) AS n, any_value(n) / (1 + exp(-(ln((1 - any_value(share)) / any_value(share)) + sum(ln(good / bad))))) AS good
            FROM long JOIN b{t} USING (j, x) GROUP BY votes)""")
        belief.append(f"""b{t + 1} AS MATERIALIZED (
            SELECT j, x, (coalesce(sum(e.n - e.good), 0) + 2 * any_value(b0.bad)) / (any_value(tb) + 2) AS bad,
                   (coalesce(sum(e.good), 0) + 2 * any_value(b0.good)) / (any_value(tg) + 2) AS good, (any_value(tb) + 0.4::DOUBLE) / (any_value(tb) + any_value(tg) + 2) AS share
            FROM b0 LEFT JOIN long USING (j, x) LEFT JOIN e{t} e USING (votes), (SELECT sum(n - good) AS tb, sum(good) AS tg FROM e{t}) GROUP BY j, x)""")
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    w AS (
        SELECT r, doc_id, t, list_filter(string_split_regex(t, '{space}'), lambda x: x <> '') AS ws,
               list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')) AS lines FROM d
    ),
    win AS (SELECT r, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS k FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
    often AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM win) WHERE c > 1),
    rep AS (SELECT r, sum(s)::BIGINT AS n FROM (SELECT r, least(8, i - lag(i, 1, -8) OVER (PARTITION BY r ORDER BY i)) AS s FROM often) GROUP BY r),
    f AS MATERIALIZED (
        SELECT r, doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
               len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(list_distinct(ws)) AS n_distinct,
               len(list_filter(ws, lambda x: lower(x) IN ({known}))) AS n_function, len(list_filter(ws, lambda x: NOT regexp_matches(x, '[\\p{{L}}\\p{{N}}]'))) AS n_lone,
               len(list_filter(ws, lambda x: right(x, 1) IN ('.', '!', '?'))) AS n_ends, length(t) - length(regexp_replace(t, '[!?]', '', 'g')) AS n_exclamations,
               length(regexp_replace(t, '\\P{{L}}', '', 'g')) AS n_letters, length(regexp_replace(t, '\\P{{Lu}}', '', 'g')) AS n_upper
        FROM w LEFT JOIN rep USING (r)
    ),
    v AS MATERIALIZED (SELECT *, {votes} AS votes FROM f),
    pat AS MATERIALIZED (SELECT votes, count(*)::DOUBLE AS n FROM v GROUP BY votes),
    long AS MATERIALIZED (SELECT votes, n, j, substr(votes, j::INT, 1) AS x FROM (SELECT votes, n, unnest(range(1, {len(VOTES) + 1})) AS j FROM pat)),
    b0 AS MATERIALIZED (
        SELECT j, x, bad, good, 0.2::DOUBLE AS share
        FROM (SELECT unnest(range(1, {len(VOTES) + 1})) AS j), (VALUES ('b', 0.27::DOUBLE, 0.018::DOUBLE), ('g', 0.63::DOUBLE, 0.882::DOUBLE), ('-', 0.1::DOUBLE, 0.1::DOUBLE)) c(x, bad, good)
    ),
    {", ".join(belief)},
    q AS (SELECT votes, 1 / (1 + exp(-(ln((1 - any_value(share)) / any_value(share)) + sum(ln(good / bad))))) AS quality FROM long JOIN b{rounds} USING (j, x) GROUP BY votes)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
           NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND quality >= 0.5 AS kept, votes, floor(quality * 1e6 + 0.501) / 1e6 AS quality
    FROM v JOIN q USING (votes)
    """


ORACLE: dict[str, str] = {"op1_exact_dedup": EXACT_DEDUP, "op2_licences": _licences(), "op5_chat": _chat(), "op11_vector_codes": _vector_codes(), "op12_fill_in_middle": FILL_IN_MIDDLE, "op13_quality_rules": _quality_rules()}
