"""SQL for the core queries that DuckDB can express."""

from __future__ import annotations

from vedomost.functions.fold import COMPOSED, GREEK_AS_CYRILLIC, HYPHENS, LATIN_AS_CYRILLIC, LETTERS_AS_DIGITS, compat_table, ignorable, odd_spaces
from vedomost.schemas import AMENDMENT_MARKS, CONSENSUS_FIELDS, DATE_FIELDS, EVIDENCE_FIELDS, TRANSFER_FIELDS


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def translated(x: str, pairs: dict[str, str], drop: str = "") -> str:
    return f"translate({x}, {q(''.join(pairs) + drop)}, {q(''.join(pairs.values()))})"


def nfkc(x: str) -> str:
    """NFKC as far as it maps one character to one, and № and …"""
    return f"nfc_normalize({translated(f'replace(replace({x}, {q(chr(0x2116))}, {q('No')}), {q(chr(0x2026))}, {q('...')})', compat_table() | dict.fromkeys(odd_spaces(), ' '))})"


def normalized(x: str) -> str:
    return rf"trim(regexp_replace({translated(nfkc(x), {'ё': 'е', 'Ё': 'Е'})}, '\s+', ' ', 'g'))"


def compare_key(x: str) -> str:
    k = f"translate(lower(coalesce({normalized(x)}, '')), {q(chr(171) + chr(187) + '„“”' + chr(34) + chr(39))}, '')"
    k = f"regexp_replace({k}, '[‐‑‒–—−]', '-', 'g')"
    k = rf"regexp_replace({k}, '(^|[^0-9a-zа-я_])(\d+(?:[.,]\d+)?)\s*(?:кв|kb)($|[^0-9a-zа-я_])', '\1\2 кв\3', 'g')"
    k = rf"regexp_replace({k}, '(^|[^0-9a-zа-я_])(\d+(?:[.,]\d+)?)\s*мва($|[^0-9a-zа-я_])', '\1\2 мва\3', 'g')"
    return f"trim({k}, ' .,;:')"


def day(x: str) -> str:
    return rf"CASE WHEN regexp_full_match({x}, '\d{{1,2}}\.\d{{1,2}}\.\d{{4}}') THEN try_strptime({x}, '%d.%m.%Y')::DATE END"


def column(f: str) -> str:
    return "end_date" if f == "end" else f


_SEP = r"[\s_–—-]*"
_IDS = (
    (rf"(?i)(^|[^0-9A-Za-zА-Яа-я])(?:38|3[ВB]|З8){_SEP}(\d{{1,2}}){_SEP}(\d{{1,2}}){_SEP}(20\d{{2}})($|[^0-9])", r"38-\2-\3-\4"),
    (r"(?i)(^|[^0-9])(?:38|3[ВB]|З8)(\d{1,2})(\d{1,2})(20\d{2})($|[^0-9])", r"38-\2-\3-\4"),
    (rf"(?i)(^|[^0-9A-Za-zА-Яа-я])(?:RU|R[УY]|Р[УY]){_SEP}(\d{{8}}){_SEP}(\d{{2}}){_SEP}(20\d{{2}})($|[^0-9])", r"RU-\2-\3-\4"),
)


def identities(x: str) -> str:
    """A sorted list of the permit numbers in a cell."""
    source = normalized(f"replace({x}, '№', ' ')")
    parts = [f"list_transform(regexp_extract_all(s, {q(p)}, 0), lambda m: regexp_replace(m, {q(p)}, {q(r)}))" for p, r in _IDS]
    return f"(SELECT list_sort(list_distinct(list_concat(list_concat({parts[0]}, {parts[1]}), {parts[2]}))) FROM (SELECT coalesce({source}, '') AS s))"


def merged_cte() -> str:
    """CTEs base0 .. m: the merge of versions, one row per number."""
    count = " + ".join(f"({column(f)} IS NOT NULL)::INT" for f in EVIDENCE_FIELDS)
    amend = f"regexp_matches(lower(coalesce(filename, '')), {q('|'.join(AMENDMENT_MARKS))})"
    keys = ", ".join(f"CASE WHEN amendment AND n_ev > 0 AND {f} IS NOT NULL THEN " + (f"strftime({day(f)}, '%Y-%m-%d')" if f == "issue" else compare_key(f)) + f" END AS key_{f}" for f in CONSENSUS_FIELDS)
    offers = []
    for f in CONSENSUS_FIELDS:
        rank = f"row(coalesce(filename, ''), coalesce(pdf, ''))"
        offers.append(f"min(key_{f}) AS least_{f}, max(key_{f}) AS most_{f}, arg_max(row({f}), {rank}) FILTER (key_{f} IS NOT NULL) AS said_{f}")
    for f in ("end", "changed"):
        d = day(column(f))
        offers.append(f"arg_max({{'v': {column(f)}, 'file': filename, 'pdf': pdf, 'q': field_quality[{q(f)}]}}, row({d}, coalesce(filename, ''), coalesce(pdf, ''))) FILTER (amendment AND n_ev > 0 AND {d} IS NOT NULL) AS latest_{f}")
    for f in DATE_FIELDS:
        offers.append(f"coalesce(bool_or({column(f)} IS NOT NULL AND {day(column(f))} IS NULL), FALSE) AS bad_{f}")
    quality = ", ".join(f"arg_max(row(field_quality[{q(f)}]), row(coalesce(filename, ''), coalesce(pdf, ''))) FILTER (key_{f} IS NOT NULL) AS q_{f}" for f in CONSENSUS_FIELDS)
    start = ", ".join(f"CASE WHEN NOT existing_only{f' AND {day(f'b.{column(f)}')} IS NOT NULL' if f in DATE_FIELDS else ''} THEN b.{column(f)} END AS start_{f}" for f in EVIDENCE_FIELDS)
    final = []
    for f in CONSENSUS_FIELDS:
        agree = f"(start_{f} IS NULL AND least_{f} = most_{f})"
        final.append(f"CASE WHEN {agree} THEN said_{f}[1] ELSE start_{f} END AS f_{f}, (start_{f} IS NULL AND least_{f} < most_{f}) IS TRUE AS conflict_{f}, CASE WHEN {agree} THEN q_{f}[1] WHEN start_{f} IS NOT NULL THEN b.field_quality[{q(f)}] END AS quality_{f}")
    for f in ("end", "changed"):
        later = f"(latest_{f} IS NOT NULL AND (start_{f} IS NULL OR {day(f'latest_{f}.v')} > {day(f'start_{f}')}))"
        final.append(f"CASE WHEN {later} THEN latest_{f}.v ELSE start_{f} END AS f_{f}, CASE WHEN {later} THEN latest_{f} END AS won_{f}, CASE WHEN {later} THEN latest_{f}.q WHEN start_{f} IS NOT NULL THEN b.field_quality[{q(f)}] END AS quality_{f}")
    return f"""base0 AS (SELECT *, {count} AS n_ev, {amend} AS amendment FROM rns_records),
    base1 AS (SELECT *, {keys}, coalesce({day('changed')}, DATE '0001-01-01') AS changed_day FROM base0),
    picked AS (SELECT *, row_number() OVER (PARTITION BY number ORDER BY (NOT amendment) DESC, n_ev DESC, changed_day DESC, coalesce(filename, '') DESC, coalesce(pdf, '') DESC) AS place FROM base1),
    bases AS (SELECT * FROM picked WHERE place = 1),
    groups AS (SELECT number, count(*) FILTER (NOT amendment) = 0 AS existing_only, count(*) FILTER (NOT amendment) AS n_permits, {', '.join(offers)}, {quality} FROM base1 GROUP BY number),
    started AS (SELECT g.*, b, {start} FROM groups g JOIN bases b ON g.number IS NOT DISTINCT FROM b.number),
    m AS (SELECT number, existing_only, b.warnings AS base_warnings, b.filename AS base_file, {', '.join(f'bad_{f}' for f in DATE_FIELDS)}, {', '.join(final)} FROM started)"""


def reconciled_cte() -> str:
    """CTEs on top of m: cells, found, j, f (one row per number and field), ch."""

    def shown(f: str, c: str) -> str:
        return f"strftime({c}, '%d.%m.%Y')" if f in DATE_FIELDS else f"nullif({c}, '')"

    cells = ", ".join(f"{shown(f, column(f))} AS c_{f}" for f in TRANSFER_FIELDS)
    proposed = {f: f"strftime({day(f'f_{f}')}, '%d.%m.%Y')" if f in DATE_FIELDS else f"f_{f}" for f in TRANSFER_FIELDS}
    fields = " UNION ALL ".join(
        f"SELECT number, row_no, {q(f)} AS field, trim(CASE WHEN row_no IS NOT NULL THEN c_{f} END) AS shown, CASE WHEN row_no IS NOT NULL THEN c_{f} END AS existing, {proposed[f]} AS proposed, "
        f"coalesce(quality_{f}.status <> 'actionable', FALSE) AS weak, {compare_key(f'c_{f}')} <> {compare_key(proposed[f])} AS differs FROM j WHERE NOT blocked AND NOT bare"
        for f in TRANSFER_FIELDS
    )
    bare = " AND ".join(f"({proposed[f]}) IS NULL" for f in TRANSFER_FIELDS)
    n_merge = " + ".join(f"conflict_{f}::INT" for f in CONSENSUS_FIELDS)
    return f"""cells AS (SELECT row_no, reg_id, {identities("nullif(number, '')")} AS ids, {cells} FROM register_rows),
    found AS (SELECT id, count(*) FILTER (n = 1) AS n_exact, count(*) FILTER (n > 1) AS n_amb, arg_min(row_no, row_no) FILTER (n = 1) AS hit FROM (SELECT unnest(ids) AS id, len(ids) AS n, row_no FROM cells) GROUP BY id),
    j0 AS (SELECT m.*, coalesce(n_exact, 0) AS n_exact, coalesce(n_amb, 0) AS n_amb, CASE WHEN coalesce(n_exact, 0) = 1 AND coalesce(n_amb, 0) = 0 THEN hit END AS hit_row FROM m LEFT JOIN found ON m.number = found.id),
    j1 AS (SELECT *, n_exact > 1 OR n_amb > 0 AS several FROM j0),
    j AS (SELECT j1.*, several OR (existing_only AND n_exact = 0) AS blocked, NOT (several OR (existing_only AND n_exact = 0)) AND {bare} AS bare, {n_merge} AS n_merge, cells.* EXCLUDE (ids) FROM j1 LEFT JOIN cells ON cells.row_no = hit_row),
    f0 AS ({fields}),
    f AS (SELECT *, CASE WHEN proposed IS NULL THEN 'skip' WHEN weak AND existing IS NULL THEN 'weak' WHEN weak AND differs THEN 'weak_conflict' WHEN weak THEN 'equal' WHEN existing IS NULL THEN 'write' WHEN differs THEN 'conflict' ELSE 'equal' END AS action FROM f0),
    per AS (SELECT number, count(*) FILTER (action IN ('weak', 'weak_conflict', 'conflict')) AS n_field_issues, count(*) FILTER (action = 'write') AS n_writes FROM f GROUP BY number),
    ch AS (SELECT j.number, j.row_no, NOT blocked AND NOT bare AND j.row_no IS NULL AS new, j.blocked, j.bare, j.several, j.n_exact,
        CASE WHEN blocked THEN 1 WHEN bare THEN greatest(n_merge, 1) ELSE n_merge + coalesce(n_field_issues, 0) END AS n_issues,
        coalesce(n_writes, 0) + (NOT blocked AND NOT bare AND j.row_no IS NULL)::INT AS n_written FROM j LEFT JOIN per ON j.number = per.number),
    changes AS (SELECT *, CASE WHEN blocked THEN 'review_conflict' WHEN bare OR n_issues > 0 THEN 'review' WHEN new THEN 'added' WHEN n_written > 0 THEN 'updated' ELSE 'already_present' END AS outcome FROM ch)"""


def _numbered() -> str:
    return "SELECT number, row_number() OVER (ORDER BY number) AS place FROM changes WHERE new"


def _last() -> str:
    return "(SELECT coalesce(max(row_no), 3) AS last_row, coalesce(max(reg_id), 0) AS last_id FROM register_rows)"


def _p1() -> str:
    """The differences by plain comparison of both sides, without unpivoting."""
    fold = lambda x: nfkc_fold(x)
    dashed = lambda x: f"regexp_replace({fold(x)}, '[‒-―]', '-', 'g')"
    number = r"(?:^|[^0-9A-Za-zА-Яа-яЁё]|[UuУу])(\d+(?:[\s_.-]+\d+){2,})(?:$|[^0-9A-Za-zА-Яа-яЁё])"
    cyr = LATIN_AS_CYRILLIC | GREEK_AS_CYRILLIC
    rest = lambda x: rf"nullif(trim(regexp_replace(lower({translated(dashed(x), cyr)}), '[^0-9a-zа-яё]+', ' ', 'g')), '')"
    num = lambda x: f"CASE WHEN regexp_extract({translated(dashed(x), LETTERS_AS_DIGITS)}, {q(number)}, 1) <> '' THEN regexp_replace(regexp_extract({translated(dashed(x), LETTERS_AS_DIGITS)}, {q(number)}, 1), '[\\s_.-]+', '-', 'g') ELSE {rest(x)} END"
    low = dict(zip("aceopxykmt", "асеорхукмт"))
    words = lambda x: rf"nullif(trim(regexp_replace({translated(translated(f'lower({translated(fold(x), cyr)})', {'ё': 'е', '№': ' '}), low)}, '[^0-9a-zа-яё]+', ' ', 'g')), '')"
    t = f"regexp_replace({fold('end_date')}, '[‒-―_]', '-', 'g')"
    dmy, iso = r"(?:^|[^0-9])(\d{1,2})\s*[-./]\s*(\d{1,2})\s*[-./]\s*(\d{4})(?:$|[^0-9])", r"(?:^|[^0-9])(\d{4})\s*[-./]\s*(\d{1,2})\s*[-./]\s*(\d{1,2})(?:$|[^0-9])"
    piece = lambda p, g: f"regexp_extract({t}, {q(p)}, {g})"
    parsed = f"CASE WHEN regexp_matches({t}, {q(dmy)}) THEN try_cast(concat({piece(dmy, 3)}, '-', {piece(dmy, 2)}, '-', {piece(dmy, 1)}) AS DATE) WHEN regexp_matches({t}, {q(iso)}) THEN try_cast(concat({piece(iso, 1)}, '-', {piece(iso, 2)}, '-', {piece(iso, 3)}) AS DATE) END"
    return f"""WITH r AS (SELECT DISTINCT reg_id, {num('number')} AS number, strftime(end_date, '%Y-%m-%d') AS end_date, {words('builder')} AS builder FROM register_rows),
    latest AS (SELECT * FROM register_copy QUALIFY row_number() OVER (PARTITION BY reg_id ORDER BY synced_at DESC, copy_id DESC) = 1),
    c AS (SELECT reg_id, {num('number')} AS number, CASE WHEN trim(end_date) <> '' THEN coalesce(strftime({parsed}, '%Y-%m-%d'), 'text:' || lower(trim(end_date))) END AS end_date, {words('builder')} AS builder FROM latest)
    SELECT reg_id, 'missing_in_copy' AS diff FROM r WHERE reg_id NOT IN (SELECT reg_id FROM c)
    UNION ALL SELECT reg_id, 'missing_in_register' FROM c WHERE reg_id NOT IN (SELECT reg_id FROM r)
    UNION ALL SELECT reg_id, 'number' FROM r JOIN c USING (reg_id) WHERE r.number IS DISTINCT FROM c.number
    UNION ALL SELECT reg_id, 'end_date' FROM r JOIN c USING (reg_id) WHERE r.end_date IS DISTINCT FROM c.end_date
    UNION ALL SELECT reg_id, 'builder' FROM r JOIN c USING (reg_id) WHERE r.builder IS DISTINCT FROM c.builder"""


def nfkc_fold(x: str) -> str:
    pairs = compat_table() | dict.fromkeys(odd_spaces(), " ") | dict.fromkeys(HYPHENS.replace("­", ""), "-")
    drop = "".join(c for c in ignorable() if c not in pairs)
    pairs = {a: b for a, b in pairs.items() if a not in ignorable()}
    out = translated(x, pairs, drop)
    for a, b in COMPOSED.items():
        out = f"replace({out}, {q(a)}, {q(b)})"
    return out


def oracle_sql() -> dict[str, str]:
    m = "WITH " + merged_cte()
    r = f"{m}, {reconciled_cte()}"
    missing = ", ".join(f"CASE WHEN f_{f} IS NULL THEN {q(f)} END" for f in EVIDENCE_FIELDS)
    lost = ", ".join(f"CASE WHEN f_{f} IS NULL AND bad_{f} THEN {q('invalid_date:' + f)} END" for f in DATE_FIELDS)
    codes = ", ".join(f"CASE WHEN conflict_{f} THEN {q('conflicting_directive_field:' + f)} END" for f in CONSENSUS_FIELDS)
    filled = ", ".join(f"CASE WHEN f_{f} IS NOT NULL THEN {q(f)} END" for f in EVIDENCE_FIELDS)
    writes = ", ".join(f"max(proposed) FILTER (field = {q(f)} AND action = 'write') AS w_{f}" for f in TRANSFER_FIELDS)
    name = lambda f: f"{f}_" if f == "end" else f
    gap = "SELECT line_id, b.left - a.left - a.width AS gap, a.left + a.width + (b.left - a.left - a.width) / 2.0 AS mid, page_width, scan_id, page, line_no"
    gaps = f"""WITH l AS (SELECT DISTINCT ON (line_id) * FROM ocr_lines WHERE line_no > 0), p AS (SELECT l.*, words[i] AS a, words[i + 1] AS b FROM l, unnest(range(1, len(words))) AS t(i)),
    g AS ({gap} FROM p), ok AS (SELECT * FROM g WHERE page_width > 0 AND gap >= greatest(45.0, page_width * 0.035) AND mid BETWEEN page_width * 0.28 AND page_width * 0.75),
    best AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY line_id ORDER BY gap DESC, mid DESC) = 1)"""
    out = {
        "p1_found": _p1(),
        "compare_keys": f"SELECT DISTINCT rec_id, {', '.join(f'{compare_key(f)} AS {f}_key' for f in ('issuer', 'builder', 'developer', 'object'))} FROM rns_records",
        "register_identities": f"SELECT row_no, array_to_string({identities('number')}, ',') AS ids FROM register_rows",
        "merge_select_base": f"{m} SELECT g.number, b.filename, b.pdf, b.n_ev::BIGINT AS n_evidence, g.n_permits FROM groups g JOIN bases b ON g.number IS NOT DISTINCT FROM b.number",
        "merge_latest_date": f"{m} SELECT number, f_end AS end_date, f_changed AS changed, coalesce(won_changed.file, won_end.file, base_file) AS filename FROM m",
        "merge_consensus": f"{m} SELECT number, {', '.join(f'f_{f} AS {f}' for f in CONSENSUS_FIELDS)}, array_to_string(list_sort(list_filter([{codes}], lambda x: x IS NOT NULL)), ',') AS issues FROM m",
        "merge_warnings": f"{m} SELECT number, array_to_string(list_sort(list_distinct(list_concat(list_filter(base_warnings, lambda w: NOT list_contains(list_filter([{filled}], lambda x: x IS NOT NULL), w)), list_filter([{missing}, {lost}, {codes}], lambda x: x IS NOT NULL)))), ',') AS warnings, existing_only FROM m",
        "merge_sources": f"{m} SELECT number, filename FROM bases UNION SELECT number, filename FROM base1 WHERE amendment AND n_ev > 0 UNION SELECT b.number, filename FROM base1 b JOIN groups g ON b.number = g.number WHERE g.existing_only",
        "unlinked_directives": f"{m} SELECT DISTINCT number, filename, 'Изменение/продление не связано: недостаточно подтверждённых данных.' AS error FROM base1 WHERE amendment AND n_ev = 0",
        "reconcile_outcomes": f"{r} SELECT number, row_no, new, outcome, n_issues::BIGINT AS n_issues, n_written::BIGINT AS n_written FROM changes",
        "reconcile_conflicts": f"{r} SELECT number, row_no, 'number' AS field, CASE WHEN n_exact > 1 THEN 'несколько строк Excel' WHEN several THEN 'несколько номеров РНС в ячейке Excel' ELSE 'строка Excel не найдена' END AS existing, number AS proposed, 'review_conflict' AS action FROM changes WHERE outcome = 'review_conflict' UNION ALL SELECT number, row_no, field, shown, proposed, 'Перенести изменения' FROM f WHERE action IN ('conflict', 'weak_conflict')",
        "reconcile_register": f"""{r}, w AS (SELECT number, row_no, {writes} FROM f GROUP BY number, row_no), numbered AS ({_numbered()})
        SELECT row_no, reg_id, nullif(number, '') AS number, {', '.join(f'coalesce(c_{f}, w_{f}) AS {name(f)}' for f in TRANSFER_FIELDS)} FROM (SELECT cells.*, register_rows.number, {', '.join(f'w_{f}' for f in TRANSFER_FIELDS)} FROM cells JOIN register_rows USING (row_no) LEFT JOIN (SELECT * EXCLUDE (number) FROM w WHERE row_no IS NOT NULL) AS hit USING (row_no))
        UNION ALL SELECT (last_row + place)::INT, (last_id + place)::BIGINT, n.number, {', '.join(f'w_{f}' for f in TRANSFER_FIELDS)} FROM numbered n JOIN w ON n.number = w.number CROSS JOIN {_last()}""",
        "new_row_ids": f"{r}, numbered AS ({_numbered()}) SELECT number, (last_row + place)::INT AS row_no, (last_id + place)::BIGINT AS reg_id FROM numbered CROSS JOIN {_last()}",
        "cell_diff": f"{r} SELECT field, count(*) AS n_changed, count(existing) AS n_overwritten FROM (SELECT field, existing FROM f WHERE action = 'write' UNION ALL SELECT 'number', NULL FROM changes WHERE new) GROUP BY field",
        "publication_check": f"{r} SELECT 'filled_cell_changed' AS rule, row_no, field FROM f WHERE action = 'write' AND existing IS NOT NULL UNION ALL SELECT 'present_row_changed', f.row_no, field FROM f JOIN changes c ON f.number = c.number WHERE action = 'write' AND outcome = 'already_present'",
        "row_cards": f"{r} SELECT c.number, c.row_no, outcome, outcome IN ('review', 'review_conflict') AS needs_review, coalesce(c.row_no >= 4, FALSE) AND (new OR outcome IN ('review', 'review_conflict')) AS editable, coalesce(won_changed.file, won_end.file, base_file) AS filename FROM changes c JOIN m ON c.number = m.number",
        "doc_title": r"""WITH l AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]'), lambda x: regexp_matches(x, '[^\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]')) AS l FROM documents)
        SELECT doc_id, substring(array_to_string(l[1:3], chr(10)), 1, 600) AS title FROM l""",
        "document_dates": r"""WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '(\d{2}\.\d{2}\.20\d{2})', 1) AS d FROM documents), v AS (SELECT doc_id, d, list_filter(d, lambda x: try_strptime(x, '%d.%m.%Y') IS NOT NULL) AS ok FROM t)
        SELECT doc_id, len(ok)::BIGINT AS n_valid, len(ok) < len(d) AS any_invalid, strftime(list_max(list_transform(ok, lambda x: try_strptime(x, '%d.%m.%Y'))), '%d.%m.%Y') AS latest FROM v""",
        "add_months": f"SELECT DISTINCT rec_id, strftime({day('issue')} + INTERVAL 13 MONTH, '%d.%m.%Y') AS later FROM rns_records WHERE {day('issue')} IS NOT NULL",
        "field_quality": "SELECT field, q.status, q.reason, count(*) AS n, round(min(q.confidence), 1) AS least FROM (SELECT unnest(map_keys(field_quality)) AS field, unnest(map_values(field_quality)) AS q FROM rns_records WHERE field_quality IS NOT NULL) GROUP BY ALL",
        "redact_paths": r"SELECT DISTINCT rec_id, regexp_extract(pdf, '([^/]+)$', 1) AS pdf, 'cannot open ''[локальный путь]'', skipped' AS error FROM rns_records",
        "file_manifest": "SELECT sha256(coalesce(text, '')) AS sha256, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1",
        "trace_summary": "SELECT sum(n)::BIGINT AS documents, sum(bad)::BIGINT AS failed, string_agg(route || '=' || n, ',' ORDER BY route) AS routes, sum(n)::BIGINT AS total_pages, sum(ms)::BIGINT AS total_ms FROM (SELECT event_type AS route, count(*) AS n, count(*) FILTER (event_type = 'error') AS bad, sum(floor(value))::BIGINT AS ms FROM events GROUP BY 1)",
        "history_validate": "SELECT user_id, count(*) AS n_items, bool_and(coalesce(try_cast(json_extract_string(props, '$.k') AS INT) >= 4 AND value >= 0, FALSE)) AS accepted FROM events GROUP BY 1",
        "progress_running_max": "SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS progress FROM events",
        "line_gaps": f"{gaps} SELECT line_id, gap::DOUBLE AS gap, mid::DOUBLE AS mid FROM best",
        "page_boundary": f"{gaps}, bins AS (SELECT scan_id, page, round_even(mid / greatest(40, page_width // 20), 0) AS bin, count(*) AS n, median(mid) AS md, min(line_no) AS first, max(page_width) AS w FROM best GROUP BY 1, 2, 3) SELECT scan_id AS doc_id, page, md AS boundary FROM bins QUALIFY row_number() OVER (PARTITION BY scan_id, page ORDER BY n DESC, -abs(md - w / 2.0) DESC, first) = 1",
        "layout_text": "SELECT DISTINCT line_id, array_to_string(list_transform(words, lambda w: w.text), ' ') AS line FROM ocr_lines WHERE line_no > 0",
    }
    return out


