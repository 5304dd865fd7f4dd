"""SQL of the corpus queries that SQL can express, from the same rules and thresholds."""

from __future__ import annotations

from . import contamination, mixing, quality, url_filter

_SPACE = r"[\x20\x09-\x0D]"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# Fixed values, written by hand: each pattern, its meaning as a regular expression, whether it blocks, its whole tokens.
_LABEL, _END = r"^[a-z][a-z0-9+.-]*://([^/?#]*[.])?", r"([^a-z0-9_.%-]|$)"
_URL_PATTERNS = [
    ("||spam-farm.", _LABEL + "spam-farm[.]", True, ["spam", "farm"]),
    ("||casino*.example.", _LABEL + "casino.*[.]example[.]", True, ["example"]),
    ("/adserver/*", "/adserver/", True, ["adserver"]),
    ("/banner*.gif|", "/banner.*[.]gif$", True, ["gif"]),
    ("^tracker^", "([^a-z0-9_.%-]|$)tracker" + _END, True, ["tracker"]),
    ("&affiliate_id=", "[&]affiliate_id=", True, ["affiliate", "id"]),
    ("?utm_source=feed^", "[?]utm_source=feed" + _END, True, ["utm", "source", "feed"]),
    ("||click.*/redirect^", _LABEL + "click[.].*/redirect" + _END, True, ["click", "redirect"]),
    ("/popup^", "/popup" + _END, True, ["popup"]),
    ("|https://ads.", "^https://ads[.]", True, ["https", "ads"]),
    ("@@||blog.*?utm_source=feed^", _LABEL + "blog[.].*[?]utm_source=feed" + _END, False, ["blog", "utm", "source", "feed"]),
    ("@@/docs/*", "/docs/", False, ["docs"]),
    ("@@||m.*^popup^", _LABEL + "m[.].*([^a-z0-9_.%-]|$)popup" + _END, False, ["m", "popup"]),
]


def _url_filter() -> str:
    hosts = ", ".join(f"({_quoted(h)}, {_quoted(p)}, {_quoted(v)})" for h, p, v in url_filter.HOST_RULES)
    patterns = ", ".join(f"({i}, {_quoted(p)}, {_quoted('(?s)' + regex)}, {blocks})" for i, (p, regex, blocks, _) in enumerate(_URL_PATTERNS))
    tokens = ", ".join(f"({i}, {_quoted(t)})" for i, (*_, whole) in enumerate(_URL_PATTERNS) for t in whole)
    return rf"""
    WITH hosts(h, p, v) AS (VALUES {hosts}), patterns(i, pattern, regex, blocks) AS (VALUES {patterns}),
    tokens(i, t) AS (VALUES {tokens}),
    parts AS (SELECT page_id, coalesce(url, '') AS url,
      translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
      regexp_extract_all(lower(coalesce(url, '')), '[a-z0-9]+') AS words FROM pages),
    urls AS (SELECT DISTINCT * FROM parts),
    ruled AS (SELECT u.page_id, u.url, arg_max(h.h || h.p, length(h.h || h.p)) AS rule, arg_max(h.v, length(h.h || h.p)) AS verdict
      FROM urls u JOIN hosts h ON (u.host = h.h OR ends_with(u.host, '.' || h.h)) AND starts_with(u.path, h.p) GROUP BY ALL),
    found AS (SELECT u.page_id, u.url, arg_min(p.pattern, (p.blocks, p.i)) AS pattern, min((p.blocks, p.i)) AS best
      FROM urls u JOIN patterns p ON regexp_matches(lower(u.url), p.regex) GROUP BY ALL),
    frequency AS (SELECT t.t, count(u.page_id) AS n FROM (SELECT DISTINCT t FROM tokens) t LEFT JOIN parts u ON list_contains(u.words, t.t) GROUP BY ALL),
    rarest AS (SELECT i, arg_min(t, (n, -length(t), t)) AS t FROM tokens JOIN frequency USING (t) GROUP BY i),
    offered AS (SELECT u.page_id, u.url, count(p.i)::INT AS n FROM urls u
      JOIN (SELECT p.i, r.t FROM patterns p LEFT JOIN rarest r USING (i)) p ON p.t IS NULL OR list_contains(u.words, p.t) GROUP BY ALL)
    SELECT u.page_id, u.host, u.path, r.rule,
      coalesce(r.verdict, CASE WHEN (f.best)[1] THEN 'block' ELSE 'allow' END) AS verdict,
      CASE WHEN r.rule IS NULL THEN f.pattern END AS pattern, coalesce(o.n, 0)::INT AS n_candidates
    FROM parts u LEFT JOIN ruled r USING (page_id, url) LEFT JOIN found f USING (page_id, url) LEFT JOIN offered o USING (page_id, url)"""


def _quality() -> str:
    stop = ", ".join(_quoted(w) for w in sorted({w for ws in quality.STOP_WORDS.values() for w in ws}))
    checks = []
    for _, over, under, least, most in quality.THRESHOLDS:
        ratio = f"({over} / nullif({under}, 0)::DOUBLE)"
        checks += [f"coalesce({ratio} < {least}, false)"] if least is not None else []
        checks += [f"coalesce({ratio} > {most}, false)"] if most is not None else []
    return rf"""
    WITH numbered AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
    cut AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
      list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM numbered),
    places AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM cut WHERE len(w) >= 3),
    twice AS (SELECT r, i FROM places QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
    repeats AS (SELECT r, count(DISTINCT i + d) AS n FROM twice, (VALUES (0), (1), (2)) s(d) GROUP BY r),
    m AS (SELECT r, doc_id, len(w) AS n_words, length(regexp_replace(text, '{_SPACE}', '', 'g')) AS word_chars,
      length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
      len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words, len(l) AS n_lines,
      length(text) - length(regexp_replace(text, '[{quality._CAPITALS}]', '', 'g')) AS n_capitals,
      len(list_filter(l, lambda x: regexp_matches(x, '^ *[-*•]'))) AS n_bullets,
      len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…) *$'))) AS n_ellipses,
      len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS n_stop_words
      FROM cut LEFT JOIN repeats USING (r))
    SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
      n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
      n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed,
      NOT (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words OR {" OR ".join(checks)}) AS kept
    FROM m"""


def _mix() -> str:
    parts = " ".join(f"WHEN {_quoted(s)} THEN {n}" for s, n in mixing.TARGET_PARTS.items())
    b = mixing.BLOCK_ROWS
    # Slot by slot: `got` are blocks of the phase, `had` blocks before it, `t0` its first slot.
    return rf"""
    WITH RECURSIVE ranked AS (SELECT doc_id, source, coalesce(source, '') AS s,
        row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY md5(doc_id::VARCHAR), doc_id) - 1 AS k FROM documents),
    sizes AS (SELECT s, CASE s {parts} ELSE 1 END AS c, (count(*) + {b - 1}) // {b} AS n FROM ranked GROUP BY s),
    start AS (SELECT list(s ORDER BY s) AS s, list(c ORDER BY s) AS c, list(n ORDER BY s) AS n FROM sizes),
    steps AS (
      SELECT 0::BIGINT AS t, 0::BIGINT AS t0, list_transform(s, lambda x: 0::BIGINT) AS got, list_transform(s, lambda x: 0::BIGINT) AS had,
        NULL::BIGINT AS chosen, NULL::BIGINT AS block, NULL::BIGINT AS release, NULL::BIGINT AS deadline FROM start
      UNION ALL
      SELECT t + 1, CASE WHEN ended THEN t + 1 ELSE t0 END,
        CASE WHEN ended THEN list_transform(now, lambda x: 0::BIGINT) ELSE now END,
        CASE WHEN ended THEN list_transform(range(1, len(now) + 1), lambda i: had[i] + now[i]) ELSE had END,
        i, had[i] + got[i], t0 + got[i] * total // c[i], t0 + ((got[i] + 1) * total + c[i] - 1) // c[i]
      FROM (SELECT *, list_transform(range(1, len(got) + 1), lambda j: got[j] + (j = i)::BIGINT) AS now, had[i] + got[i] + 1 = n[i] AS ended
        FROM (SELECT *, list_min(list_transform(list_filter(range(1, len(s) + 1), lambda j: had[j] + got[j] < n[j] AND got[j] * total // c[j] <= t - t0),
              lambda j: (((got[j] + 1) * total + c[j] - 1) // c[j]) * 100000 + j)) % 100000 AS i
          FROM (SELECT *, list_sum(list_transform(range(1, len(s) + 1), lambda j: CASE WHEN had[j] < n[j] THEN c[j] ELSE 0 END))::BIGINT AS total
            FROM steps, start) WHERE list_sum(list_transform(range(1, len(s) + 1), lambda j: n[j] - had[j] - got[j])) > 0))),
    plan AS (SELECT s[chosen] AS s, block, release, deadline, t - 1 AS slot FROM steps, start WHERE chosen IS NOT NULL)
    SELECT doc_id, source, block, release, deadline, slot, slot * {b} + k % {b} AS position
    FROM ranked JOIN plan ON ranked.s = plan.s AND ranked.k // {b} = plan.block"""


def _decontamination() -> str:
    words = lambda t: rf"regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""
    WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {words("coalesce(text, '')")} AS w FROM documents),
    items AS (SELECT item_id, {words("text")} AS w FROM benchmark WHERE text IS NOT NULL),
    windows AS (SELECT DISTINCT item_id, least(len(w), {contamination.WINDOW_WORDS}) AS k,
        unnest(list_transform(range(1, len(w) - least(len(w), {contamination.WINDOW_WORDS}) + 2), lambda i: array_to_string(w[i:i + least(len(w), {contamination.WINDOW_WORDS}) - 1], ' '))) AS win
      FROM items WHERE len(w) > 0),
    sizes AS (SELECT DISTINCT k FROM windows),
    places AS (SELECT r, k, unnest(range(1, len(w) - k + 2)) AS i, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS win
      FROM docs, sizes WHERE len(w) >= k),
    found AS (SELECT r, i, p.k, item_id FROM places p JOIN windows USING (k, win)),
    hit AS (SELECT r, count(DISTINCT i + d) AS n FROM (SELECT r, i, unnest(range(0, k)) AS d FROM found) GROUP BY r),
    names AS (SELECT r, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM found GROUP BY r)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
      sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
    FROM docs LEFT JOIN hit USING (r) LEFT JOIN names USING (r)"""


def _merkle() -> str:
    field = lambda c: f"coalesce(strlen(({c})::VARCHAR)::VARCHAR || ':' || ({c})::VARCHAR, '-')"
    leaf = lambda n: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", n, "text")) + ")"
    bits = "list_reduce([xor(c, b)] || range(8), lambda x, _: xor(x >> 1, 3988292384 * (x & 1)))"
    crc = f"xor(4294967295, list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, b: {bits}))"
    # Levels of both kinds of trees, and each leaf folded up through them.
    return f"""
    WITH RECURSIVE digests AS (SELECT row_number() OVER () AS r, doc_id, lang, {leaf("n_chars")} AS leaf,
        CASE WHEN {crc} % 7 = 0 THEN {leaf("n_chars + 1")} END AS tampered FROM documents),
    leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM digests),
    nodes AS (SELECT 0 AS level, lang, i, n, leaf AS d FROM leaves UNION ALL
      SELECT level + 1, lang, i // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY level, lang, i // 2, n),
    tops AS (SELECT lang, d, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
    upper AS (SELECT 0 AS level, i, n, d FROM tops UNION ALL
      SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY i)) FROM upper WHERE n > 1 GROUP BY level, i // 2, n),
    steps AS (
      SELECT r, v.level, (l.i >> v.level) & 1 AS slot, coalesce(s.d, '') AS s FROM leaves l JOIN (SELECT DISTINCT level, lang FROM nodes WHERE n > 1) v ON v.lang IS NOT DISTINCT FROM l.lang
        LEFT JOIN nodes s ON s.level = v.level AND s.lang IS NOT DISTINCT FROM l.lang AND s.i = xor(l.i >> v.level, 1)
      UNION ALL
      SELECT r, 1000 + v.level, (t.i >> v.level) & 1, coalesce(s.d, '') FROM leaves l JOIN tops t ON t.lang IS NOT DISTINCT FROM l.lang
        CROSS JOIN (SELECT DISTINCT level FROM upper WHERE n > 1) v LEFT JOIN upper s ON s.level = v.level AND s.i = xor(t.i >> v.level, 1)),
    numbered AS (SELECT r, row_number() OVER (PARTITION BY r ORDER BY level) AS k, slot, s FROM steps),
    folds AS (SELECT r, 0::BIGINT AS k, coalesce(tampered, leaf) AS d FROM leaves UNION ALL
      SELECT f.r, f.k + 1, sha256(CASE WHEN slot = 0 THEN d || s ELSE s || d END) FROM folds f JOIN numbered n ON n.r = f.r AND n.k = f.k + 1),
    proofs AS (SELECT r, string_agg(s, '' ORDER BY k) AS proof FROM numbered GROUP BY r)
    SELECT l.doc_id, l.leaf, t.d AS subroot, u.d AS root, sha256(coalesce(p.proof, '')) AS proof_sha256, f.d AS folded_root, f.d = u.d AS verified
    FROM leaves l JOIN tops t ON t.lang IS NOT DISTINCT FROM l.lang CROSS JOIN (SELECT d FROM upper WHERE n = 1) u
      LEFT JOIN proofs p USING (r) JOIN (SELECT r, arg_max(d, k) AS d FROM folds GROUP BY r) f USING (r)"""


ORACLE = {
    "op1_url_filter": _url_filter(), "op3_quality_rules": _quality(), "op4_mix_sources": _mix(),
    "op11_decontamination": _decontamination(), "op13_merkle_manifest": _merkle(),
}
