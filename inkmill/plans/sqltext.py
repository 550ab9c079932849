"""DuckDB counterparts of the text functions, for the oracles."""

from __future__ import annotations

from inkmill.functions import detectors as D
from inkmill.functions import metrics as M
from inkmill.functions import text as T


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _drop(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, {quoted(pattern)}, {quoted(by)}, 'g')"


def prose_scan(x: str) -> str:
    out = _drop(f"coalesce({x}, '')", T.FRONT_MATTER)
    return _drop(_drop(_drop(out, T.FENCE), T.INLINE_CODE, " "), T.QUOTED)


def prose_style(x: str) -> str:
    return _drop(prose_scan(x), T.HEADING)


def folded(x: str) -> str:
    out = _drop(x, r"[\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]", " ")
    return _drop(_drop(out, r"[^\x00-\x7F\P{L}]|[^\x00-\x7F\P{N}]", "0"), r"[^\x00-\x7F]", "#")


def times(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {quoted(pattern)}))"


def tokens(x: str) -> str:
    return f"regexp_extract_all({x}, {quoted(T.TOKEN)})"


def word_count(x: str) -> str:
    return f"len({tokens(x)})"


def blank_words(x: str) -> str:
    return times(x, f"[^{T.SPACE}]+")


def blocks(x: str) -> str:
    return f"list_transform(string_split_regex({x}, {quoted(T.PARAGRAPH_BREAK)}), lambda b: trim({_drop('b', f'[{T.SPACE}]+', ' ')}))"


def paragraphs(x: str) -> str:
    return f"list_filter({blocks(x)}, lambda p: {word_count('p')} >= 5)"


def sentences(x: str) -> str:
    cut = "string_split(regexp_replace(p, '([.!?])[\"'')\\]]* +', '\\1' || chr(1), 'g'), chr(1))"
    return f"flatten(list_transform({blocks(x)}, lambda p: list_filter(list_transform({cut}, lambda s: trim(s)), lambda s: {word_count('s')} >= 2)))"


def detector_count(key: str, text: str, plain: str) -> str:
    if key == "hedge_stack":
        cut = "string_split(regexp_replace(" + plain + ", '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
        return f"len(list_filter({cut}, lambda s: {times('s', D.HEDGE)} >= 3))"
    if key == "title_case_headings":
        small = "[" + ", ".join(map(quoted, D.SMALL_WORDS)) + "]"
        words = f"list_filter(regexp_extract_all(h, {quoted(D.WORD_ON_ASCII)}), lambda w: NOT list_contains({small}, lower(w)))"
        hit = "len(ws) >= 3 AND len(list_filter(ws[2:], lambda w: regexp_matches(w, '^[A-Z]') AND regexp_matches(w, '[a-z]'))) >= greatest(2, floor((len(ws) - 1) * 0.7))"
        return f"len(list_filter(list_transform(regexp_extract_all({plain}, {quoted(D.HEADING_LINE)}, 1), lambda h: {words}), lambda ws: {hit}))"
    whole, ascii_ones = D.PATTERNS[key]
    return " + ".join([times(text, p) for p in whole] + [times(plain, p) for p in ascii_ones])


def rate(count: str, words: str) -> str:
    return f"CASE WHEN {words} = 0 THEN 0.0::DOUBLE ELSE round({count}::DOUBLE * 1000.0 / nullif({words}, 0)::DOUBLE, 2) END"


def counts(source: str, keep: str) -> str:
    """A query for keep, words, key and count of every detector."""
    columns = ", ".join(f"({detector_count(k, 'prose', 'plain')})::BIGINT AS {k}" for k in D.DETECTORS)
    keys = ", ".join(D.DETECTORS)
    wide = f"SELECT {keep}, {word_count('prose')}::BIGINT AS words, {columns} FROM (SELECT {keep}, prose, {folded('prose')} AS plain FROM (SELECT {keep}, {prose_scan('text')} AS prose FROM {source}))"
    return f"SELECT {keep}, words, key, count FROM (UNPIVOT ({wide}) ON {keys} INTO NAME key VALUE count)"


def registry() -> str:
    rows = ", ".join(f"({quoted(d.key)}, {quoted(d.label)}, {str(d.gated).lower()}, {d.floor}::DOUBLE, {d.min_count}, {k})" for k, d in enumerate(D.DETECTORS.values()))
    return f"(VALUES {rows}) AS registry(key, label, gated, floor, min_count, pos)"


def variation(n: str, s: str, q: str) -> str:
    return f"CASE WHEN {n} >= 3 AND {s} <> 0 THEN round(sqrt(({n} * {q} - {s} * {s})::DOUBLE) / {s}::DOUBLE, 3) END"


def flat_run(x: str) -> str:
    """Of a list of lengths: the longest run of neighbours within the tolerance."""
    cells = f"list_transform({x}, lambda v: {{'best': 1::BIGINT, 'run': 1::BIGINT, 'last': v::BIGINT}})"
    run = f"CASE WHEN abs(b.last - a.last) <= {M.FLAT_TOLERANCE} THEN a.run + 1 ELSE 1 END"
    return f"CASE WHEN len({x}) < {M.FLAT_SENTENCES} THEN 0 ELSE list_reduce({cells}, lambda a, b: {{'best': greatest(a.best, {run}), 'run': {run}, 'last': b.last}}).best END"


def mtld(x: str, keep: str = "doc_id") -> str:
    """Of a list of tokens, with keep."""

    def one_way(tokens: str) -> str:
        cells = f"list_prepend({{'t': '', 'f': 0.0::DOUBLE, 's': []::VARCHAR[], 'c': 0}}, list_transform({tokens}, lambda v: {{'t': v, 'f': 0.0::DOUBLE, 's': []::VARCHAR[], 'c': 0}}))"
        seen = "CASE WHEN list_contains(a.s, b.t) THEN a.s ELSE list_append(a.s, b.t) END"
        full = f"len({seen})::DOUBLE / (a.c + 1) <= {M.MTLD_THRESHOLD}::DOUBLE"
        step = f"CASE WHEN {full} THEN {{'t': '', 'f': a.f + 1, 's': []::VARCHAR[], 'c': 0}} ELSE {{'t': '', 'f': a.f, 's': {seen}, 'c': a.c + 1}} END"
        return f"list_reduce({cells}, lambda a, b: {step})"

    def value(state: str) -> str:
        return f"n / greatest({state}.f + CASE WHEN {state}.c > 0 THEN (1 - len({state}.s)::DOUBLE / {state}.c) / (1 - {M.MTLD_THRESHOLD}::DOUBLE) ELSE 0 END, {M.MTLD_LEAST}::DOUBLE)"

    return f"SELECT {keep}, CASE WHEN n >= {M.MTLD_TOKENS} THEN ({value('fw')} + {value('bw')}) / 2 END AS mtld FROM (SELECT {keep}, len({x})::DOUBLE AS n, {one_way(x)} AS fw, {one_way(f'list_reverse({x})')} AS bw"


def measured(source: str, keep: str) -> str:
    """A query for keep and the metrics without lexical diversity."""
    return f"""SELECT {keep}, words, len(sl)::BIGINT AS sentences, len(pl)::BIGINT AS paragraphs,
      CASE WHEN len(sl) > 0 THEN round(list_sum(sl)::DOUBLE / len(sl), 1) END AS sent_len_mean,
      {variation("len(sl)", "coalesce(list_sum(sl), 0)::BIGINT", "coalesce(list_sum(list_transform(sl, lambda v: v * v)), 0)::BIGINT")} AS sent_len_cv,
      {variation("len(pl)", "coalesce(list_sum(pl), 0)::BIGINT", "coalesce(list_sum(list_transform(pl, lambda v: v * v)), 0)::BIGINT")} AS para_len_cv,
      CASE WHEN len(sents) >= 4 THEN round((len(op) - len(list_distinct(op)))::DOUBLE / len(op)::DOUBLE, 3) END AS repeated_opening_rate,
      ({flat_run("sl")})::BIGINT AS longest_flat_run
    FROM (SELECT {keep}, {word_count("prose")}::BIGINT AS words, sents, list_transform(sents, lambda s: {word_count("s")}) AS sl, list_transform(paras, lambda s: {word_count("s")}) AS pl,
        list_transform(sents, lambda s: array_to_string(({tokens("lower(s)")})[1:{M.OPENING_WORDS}], ' ')) AS op
      FROM (SELECT {keep}, prose, {sentences("prose")} AS sents, {paragraphs("prose")} AS paras FROM (SELECT {keep}, {prose_style("text")} AS prose FROM {source})))"""


def html_text(x: str) -> str:
    out = f"coalesce({x}, '')"
    for tag in T.SKIPPED_TAGS:
        out = _drop(out, rf"(?is)<{tag}\b.*?</{tag}>", " ")
    out = _drop(out, r"(?i)</(?:p|div|li|h[1-6]|blockquote)>", "\n\n")
    out = _drop(_drop(out, rf"(?i)<br[{T.SPACE}]*/?>", "\n"), "<[^>]+>", " ")
    for name, char in T.ENTITIES:
        out = f"replace({out}, {quoted(name)}, {quoted(char)})"
    out = f"replace({out}, '­', '')"
    out = _drop(_drop(_drop(out, "&#[0-9]+;", " "), "[ \t]+", " "), "\n{3,}", "\n\n")
    kept = f"list_filter(string_split({out}, chr(10)), lambda l: {times('l', f'[^{T.SPACE}]+')} > 8 OR regexp_matches(l, '[.!?]'))"
    return _drop(f"array_to_string({kept}, chr(10))", rf"\A[{T.SPACE}]+|[{T.SPACE}]+\z")


def similarity(pairs: str) -> str:
    """CTEs (recursive) that end in sim (id, similarity): tokens in matching blocks, the longest first, of pairs (id, a, b), lists of tokens."""
    return f"""pr AS MATERIALIZED ({pairs}),
      tb AS (SELECT id, unnest(b) AS t, generate_subscripts(b, 1) - 1 AS j, len(b) AS n FROM pr), ta AS (SELECT id, unnest(a) AS t, generate_subscripts(a, 1) - 1 AS i FROM pr),
      pp AS (SELECT id, t, count(*) > any_value(n) // 100 + 1 AND any_value(n) >= 200 AS popular FROM tb GROUP BY id, t),
      eq AS MATERIALIZED (SELECT id, i, j, popular FROM ta JOIN tb USING (id, t) JOIN pp USING (id, t)),
      sg AS (SELECT id, 0::BIGINT AS al, len(a)::BIGINT AS ah, 0::BIGINT AS bl, len(b)::BIGINT AS bh, 0::BIGINT AS n, true AS open FROM pr WHERE len(a) > 0 AND len(b) > 0
        UNION ALL SELECT id, u.al, u.ah, u.bl, u.bh, u.n, u.open FROM (SELECT id, unnest([
            {{'al': al, 'ah': fi, 'bl': bl, 'bh': fi - d, 'n': 0, 'open': true}}, {{'al': fi + fn, 'ah': ah, 'bl': fi - d + fn, 'bh': bh, 'n': 0, 'open': true}}, {{'al': 0, 'ah': 1, 'bl': 0, 'bh': 1, 'n': fn, 'open': false}}]) AS u
          FROM (SELECT *, row_number() OVER (PARTITION BY id, al ORDER BY cn DESC, ci, ci - d) AS r FROM (
            SELECT id, al, ah, bl, bh, d, min(i) AS ci, CASE WHEN popular THEN 0 ELSE count(*) END AS cn, any_value(fi) AS fi, any_value(fn) AS fn FROM (
              SELECT *, min(i) OVER w AS fi, count(*) OVER w AS fn FROM (
                SELECT s.id, al, ah, bl, bh, e.i, e.i - e.j AS d, popular, e.i - row_number() OVER (PARTITION BY s.id, al, e.i - e.j ORDER BY e.i) AS f,
                  e.i - row_number() OVER (PARTITION BY s.id, al, e.i - e.j, popular ORDER BY e.i) AS c FROM sg s JOIN eq e ON e.id = s.id AND e.i >= al AND e.i < ah AND e.j >= bl AND e.j < bh WHERE s.open) WINDOW w AS (PARTITION BY id, al, d, f))
            GROUP BY id, al, ah, bl, bh, d, popular, c HAVING NOT popular OR (any_value(fi) = al AND al - d = bl))) WHERE r = 1)
        WHERE u.al < u.ah AND u.bl < u.bh),
      sim AS (SELECT id, CASE WHEN len(a) + len(b) = 0 THEN 1 ELSE 2 * coalesce(m, 0)::DOUBLE / (len(a) + len(b)) END AS similarity FROM pr LEFT JOIN (SELECT id, sum(n)::BIGINT AS m FROM sg WHERE NOT open GROUP BY id) USING (id))"""


def blank_tokens(x: str) -> str:
    """The runs of anything but white space."""
    return f"regexp_extract_all({x}, {quoted(f'[^{T.SPACE}]+')})"
