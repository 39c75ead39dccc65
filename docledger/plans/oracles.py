"""The same questions as `queries`, in SQL for an independent engine."""

from __future__ import annotations

SPACES = "(' ' || " + " || ".join(
    f"chr({code})"
    for code in (
        *(9, 10, 11, 12, 13, 28, 29, 30, 31, 133, 160, 5760),
        *range(8192, 8203),
        *(8232, 8233, 8239, 8287, 12288),
    )
) + ")"


def _date(text: str) -> str:
    """The date ladder over a text expression, one guarded attempt per layout."""
    x = f"regexp_replace(trim({text}, {SPACES}), '\\s+', ' ', 'g')"
    attempts = [
        ("[0-9]{4}-[0-9]{2}-[0-9]{2}", "%Y-%m-%d"),
        ("[0-9]{8}", "%Y%m%d"),
        ("[0-9]{4}-W[0-9]{2}-[0-9]", "%G-W%V-%u"),
    ]
    rest = [
        ("[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}", "%Y/%m/%d"),
        ("[0-9]{1,2}\\.[0-9]{1,2}\\.[0-9]{4}", "%d.%m.%Y"),
        ("[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}", "%d/%m/%Y"),
        ("[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}", "%m/%d/%Y"),
        ("[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}", "%d-%m-%Y"),
        ("[0-9]{1,2} [A-Za-z]+ [0-9]{4}", "%d %b %Y"),
        ("[0-9]{1,2} [A-Za-z]+ [0-9]{4}", "%d %B %Y"),
        ("[A-Za-z]+ [0-9]{1,2}, [0-9]{4}", "%B %d, %Y"),
        ("[A-Za-z]+ [0-9]{1,2}, [0-9]{4}", "%b %d, %Y"),
    ]

    def attempt(value: str, guard: str, layout: str) -> str:
        test = f"regexp_full_match({x}, '{guard}')"
        return f"CASE WHEN {test} THEN CAST(try_strptime({value}, '{layout}') AS DATE) END"

    parts = [attempt(x, guard, layout) for guard, layout in attempts]
    parts.append(attempt(f"({x} || '-1')", "[0-9]{4}-W[0-9]{2}", "%G-W%V-%u"))
    parts += [attempt(x, guard, layout) for guard, layout in rest]
    return f"coalesce({', '.join(parts)})"


def _currency(text: str, cleaned: str | None = None) -> str:
    c = cleaned or f"upper(trim({text}, {SPACES}))"
    word = f"regexp_extract({c}, '(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_])([A-Z]{{3}})($|[^\\p{{L}}\\p{{M}}\\p{{N}}_])', 2)"
    return f"""CASE WHEN {text} IS NULL OR {text} = '' THEN NULL
        WHEN {c} = '€' THEN 'EUR' WHEN {c} = '$' THEN 'USD' WHEN {c} = '£' THEN 'GBP'
        WHEN {c} = '¥' THEN 'JPY' WHEN {c} = 'C$' THEN 'CAD' WHEN {c} = 'A$' THEN 'AUD'
        WHEN {c} IN ('FR.', 'CHF') THEN 'CHF'
        ELSE coalesce(nullif({word}, ''), {c}) END"""


FIELDS = """
orders_raw AS (
    SELECT o_orderkey AS seq, o_custkey, o_orderstatus, o_orderpriority, o_orderdate, o_totalprice,
        'doc_' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') || '.pdf' AS file_name,
        sha256(CAST(o_orderkey AS VARCHAR)) AS file_hash,
        CASE WHEN o_orderkey % 37 = 0 THEN '   ' WHEN o_orderkey % 41 = 0 THEN NULL
             ELSE ' INV-' || strftime(o_orderdate, '%Y-%m') END AS invoice_number,
        CASE WHEN o_orderkey % 47 = 0 THEN 'not-a-date' WHEN o_orderkey % 53 = 0 THEN NULL
             WHEN o_orderkey % 4 = 1 THEN strftime(o_orderdate, '%d.%m.%Y')
             WHEN o_orderkey % 4 = 2 THEN strftime(o_orderdate, '%Y/%-m/%-d')
             ELSE strftime(o_orderdate, '%Y-%m-%d') END AS invoice_date,
        CASE WHEN o_orderkey % 5 = 0 THEN NULL
             WHEN o_orderkey % 7 = 0 THEN CAST(year(o_orderdate) - 1 AS VARCHAR) || '-12-31'
             ELSE CAST(year(o_orderdate) AS VARCHAR) || '-12-31' END AS due_date,
        CASE WHEN o_orderkey % 59 = 0 THEN NULL WHEN o_orderkey % 61 = 0 THEN -o_totalprice
             WHEN o_orderkey % 67 = 0 THEN CAST(0 AS DOUBLE) ELSE o_totalprice END AS total_amount,
        (['EUR', '€', 'usd', '$', '£', 'C$', ' aud ', 'Fr.', '100 CHF', 'EUR', 'JPY'])
            [CAST(o_orderkey % 11 + 1 AS INTEGER)] AS currency,
        CAST(CASE WHEN o_orderkey % 13 = 0 THEN 0.79 ELSE 0.95 END AS DOUBLE) AS confidence_score
    FROM orders)"""

RAW = FIELDS + """,
raw AS (
    SELECT orders_raw.*, CASE WHEN seq % 43 = 0 THEN '' ELSE c_name END AS supplier_name
    FROM orders_raw JOIN customer ON o_custkey = c_custkey)"""

SEEN = """,
seen AS (SELECT file_hash FROM orders_raw WHERE o_orderstatus = 'F')"""

LEDGER = """,
ledger AS (
    SELECT file_hash, file_name, supplier_name, invoice_number,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'EXCEPTION' WHEN '2-HIGH' THEN 'FLAGGED'
             ELSE 'OK' END AS status,
        CASE WHEN o_orderpriority = '1-URGENT' THEN 'LOW_CONFIDENCE' END AS issue_type,
        o_orderdate AS processed_at
    FROM raw WHERE o_orderstatus = 'F')"""

EVENTS = """,
events_all AS (
    SELECT *, 1 AS seq FROM ledger
    UNION ALL
    SELECT file_hash, file_name, supplier_name, invoice_number, 'OK', NULL,
        processed_at + INTERVAL 1 DAY, 2
    FROM ledger WHERE status = 'EXCEPTION'),
latest AS (
    SELECT * EXCLUDE (age) FROM (
        SELECT *, row_number() OVER (PARTITION BY file_hash ORDER BY processed_at DESC, seq DESC) AS age
        FROM events_all)
    WHERE age = 1)"""

HISTORY = """,
accepted AS (
    SELECT lower(trim(supplier_name)) AS supplier_key, lower(trim(invoice_number)) AS number_key,
        file_hash
    FROM ledger WHERE status IN ('OK', 'FLAGGED')),
history AS (
    SELECT supplier_key, number_key, count(DISTINCT file_hash) AS n_hashes,
        min(file_hash) AS min_hash, max(file_hash) AS max_hash
    FROM accepted WHERE supplier_key <> '' AND number_key <> ''
    GROUP BY supplier_key, number_key)"""

NO_HISTORY = """,
history AS (
    SELECT '' AS supplier_key, '' AS number_key, 0 AS n_hashes, '' AS min_hash, '' AS max_hash
    WHERE false)"""

_ALLOWED = "'EUR', 'USD', 'GBP', 'CAD', 'AUD', 'CHF'"

JUDGED = f""",
normal AS (
    SELECT *, trim(invoice_number) AS clean_number, trim(supplier_name) AS clean_supplier,
        {_date("invoice_date")} AS parsed_date, {_date("due_date")} AS parsed_due_date,
        {_currency("currency")} AS currency_code,
        lower(trim(supplier_name)) AS supplier_key, lower(trim(invoice_number)) AS number_key
    FROM raw),
judged AS (
    SELECT *,
        CASE WHEN confidence_score IS NULL OR confidence_score < 0.8 THEN 'LOW_CONFIDENCE'
             WHEN coalesce(clean_number, '') = '' THEN 'MISSING_INVOICE_NUMBER'
             WHEN coalesce(clean_supplier, '') = '' THEN 'EXTRACTION_FAILED'
             WHEN coalesce(trim(invoice_date), '') = '' THEN 'MISSING_INVOICE_DATE'
             WHEN parsed_date IS NULL THEN 'MISSING_INVOICE_DATE'
             WHEN total_amount IS NULL OR total_amount <= 0 THEN 'INVALID_AMOUNT'
             WHEN coalesce(currency_code, '') NOT IN ({_ALLOWED}) THEN 'UNKNOWN_CURRENCY'
        END AS issue_type,
        CASE WHEN confidence_score IS NULL OR confidence_score < 0.8
                 THEN 'Confidence ' || coalesce(CAST(confidence_score AS VARCHAR), 'none')
                      || ' is under the floor of 0.8'
             WHEN coalesce(clean_number, '') = '' THEN 'The record has no invoice number'
             WHEN coalesce(clean_supplier, '') = '' THEN 'The record has no supplier name'
             WHEN coalesce(trim(invoice_date), '') = '' THEN 'The record has no invoice date'
             WHEN parsed_date IS NULL THEN 'No calendar date in ''' || invoice_date || ''''
             WHEN total_amount IS NULL OR total_amount <= 0
                 THEN 'Amount must be above 0.00, found '
                      || coalesce(CAST(total_amount AS VARCHAR), 'none')
             WHEN coalesce(currency_code, '') NOT IN ({_ALLOWED})
                 THEN 'Currency ''' || coalesce(currency, 'none') || ''' (read as '''
                      || coalesce(currency_code, 'none')
                      || ''') is none of AUD, CAD, CHF, EUR, GBP, USD'
        END AS details,
        CASE WHEN parsed_due_date IS NULL OR parsed_due_date < parsed_date THEN 'FLAGGED'
             ELSE 'OK' END AS review
    FROM normal)"""


def _decided(admitted: str) -> str:
    """Duplicates and final status; `admitted` says which rows a run works on."""
    return f""",
firsts AS (
    SELECT supplier_key, number_key, file_hash AS first_hash FROM (
        SELECT *, row_number() OVER (PARTITION BY supplier_key, number_key ORDER BY file_name) AS place
        FROM judged WHERE issue_type IS NULL AND {admitted})
    WHERE place = 1),
decided AS (
    SELECT j.*, {admitted} AS admitted,
        CASE WHEN h.n_hashes IS NULL THEN j.file_hash <> f.first_hash
             WHEN h.n_hashes = 1 THEN j.file_hash <> h.min_hash
             ELSE true END AS is_duplicate
    FROM judged j
    LEFT JOIN firsts f USING (supplier_key, number_key)
    LEFT JOIN history h USING (supplier_key, number_key)),
outcome AS (
    SELECT *,
        CASE WHEN NOT admitted THEN 'SKIPPED_CACHED'
             WHEN issue_type IS NOT NULL OR is_duplicate THEN 'EXCEPTION'
             ELSE review END AS status,
        CASE WHEN NOT admitted THEN NULL WHEN issue_type IS NOT NULL THEN issue_type
             WHEN is_duplicate THEN 'DUPLICATE_INVOICE' END AS final_issue,
        CASE WHEN NOT admitted THEN NULL WHEN issue_type IS NOT NULL THEN details
             WHEN is_duplicate THEN 'Invoice ''' || clean_number || ''' of ''' || clean_supplier
                 || ''' is already in this batch or the ledger' END AS final_details
    FROM decided)"""


BATCH = "WITH " + RAW + NO_HISTORY + JUDGED + _decided("true")
RUN = (
    "WITH "
    + RAW
    + SEEN
    + LEDGER
    + HISTORY
    + JUDGED
    + _decided("(file_hash NOT IN (SELECT file_hash FROM seen))")
)
FORCED = "WITH " + RAW + LEDGER + HISTORY + JUDGED + _decided("true")

INVOICES = """SELECT file_name, file_hash, clean_number AS invoice_number,
    clean_supplier AS supplier_name, parsed_date AS invoice_date, parsed_due_date AS due_date,
    CAST(printf('%.2f', total_amount) AS DOUBLE) AS total_amount, currency_code AS currency,
    status FROM outcome WHERE status IN ('OK', 'FLAGGED')"""
INVOICES_TEXT = """SELECT file_name, file_hash, clean_number AS invoice_number,
    clean_supplier AS supplier_name, strftime(parsed_date, '%Y-%m-%d') AS invoice_date,
    {due} AS due_date, printf('%.2f', total_amount) AS total_amount, currency_code AS currency,
    status FROM outcome WHERE status IN ('OK', 'FLAGGED')"""
_DUE = "coalesce(strftime(parsed_due_date, '%Y-%m-%d'), '')"
EXCEPTIONS = """SELECT file_name, file_hash, final_issue AS issue_type, final_details AS details
    FROM outcome WHERE status = 'EXCEPTION'"""
SUMMARY = """SELECT count(*) AS total_scanned,
    count(*) FILTER (WHERE status = 'OK') AS processed_ok,
    count(*) FILTER (WHERE status = 'FLAGGED') AS flagged_review,
    count(*) FILTER (WHERE status = 'EXCEPTION') AS exceptions_count,
    count(*) FILTER (WHERE status = 'SKIPPED_CACHED') AS skipped_cached FROM outcome"""

LABELLED = "WITH " + RAW + """,
labelled AS (
    SELECT *, concat_ws(E'\\n', supplier_name, 'INVOICE', 'Invoice Number: ' || trim(invoice_number),
        'Invoice Date: ' || invoice_date, 'Due Date: ' || due_date,
        'Currency: ' || trim(currency),
        'Total Amount: ' || format('{:,.2f}', total_amount) || ' ' || trim(currency)) AS raw_text
    FROM raw),
read AS (
    SELECT seq, nullif(trim(regexp_extract(raw_text, '^\\s*(\\S[^\\n]*)', 1)), '') AS supplier_name,
        nullif(trim(regexp_extract(raw_text, '(?m)^Invoice Number: *(\\S[^\\n]*)$', 1)), '')
            AS invoice_number,
        nullif(trim(regexp_extract(raw_text, '(?m)^Invoice Date: *(\\S[^\\n]*)$', 1)), '')
            AS invoice_date,
        nullif(trim(regexp_extract(raw_text, '(?m)^Due Date: *(\\S[^\\n]*)$', 1)), '') AS due_date,
        TRY_CAST(replace(regexp_extract(raw_text, '(?m)^Total Amount: *(-?[0-9,]+\\.[0-9]+)', 1),
            ',', '') AS DOUBLE) AS total_amount,
        nullif(trim(regexp_extract(raw_text, '(?m)^Currency: *(\\S[^\\n]*)$', 1)), '') AS currency,
        CAST(1 AS DOUBLE) AS confidence_score, CAST(NULL AS VARCHAR) AS extract_error
    FROM labelled)
SELECT * FROM read"""

ANSWERED = "WITH " + RAW + """,
answered AS (
    SELECT *, CASE WHEN seq % 73 = 1 THEN '' WHEN seq % 73 = 2 THEN 'null'
        WHEN seq % 73 = 3 THEN 'I cannot read this document' WHEN seq % 73 = 4 THEN '[1]'
        WHEN seq % 73 = 5 THEN NULL
        ELSE '{' || CASE WHEN seq % 71 = 0 THEN '"invoice_number":12'
                ELSE '"invoice_number":' || coalesce('"' || invoice_number || '"', 'null') END
            || ',"supplier_name":' || coalesce('"' || supplier_name || '"', 'null')
            || ',"invoice_date":' || coalesce('"' || invoice_date || '"', 'null')
            || ',"due_date":' || coalesce('"' || due_date || '"', 'null')
            || ',"total_amount":' || coalesce(CASE
                WHEN seq % 29 = 0 THEN '"' || CAST(total_amount AS VARCHAR) || '"'
                WHEN seq % 31 = 0 THEN '"a lot"' ELSE CAST(total_amount AS VARCHAR) END, 'null')
            || ',"currency":' || coalesce('"' || currency || '"', 'null')
            || CASE WHEN seq % 17 = 0 THEN ',"confidence_score":null' WHEN seq % 19 = 0 THEN ''
                    WHEN seq % 23 = 0 THEN ',"confidence_score":1.5'
                    ELSE ',"confidence_score":' || CAST(confidence_score AS VARCHAR) END
            || ',"page":1}' END AS response
    FROM raw),
checked AS (
    SELECT seq, response,
        CASE WHEN response IS NOT NULL AND json_valid(response) THEN CAST(response AS JSON) END AS j
    FROM answered),
bound AS (
    SELECT *, coalesce(json_type(j) = 'OBJECT', false) AS is_object,
        TRY_CAST(j ->> '$.total_amount' AS DOUBLE) AS amount,
        CASE WHEN json_type(j) = 'OBJECT' AND NOT json_exists(j, '$.confidence_score') THEN 1.0
             ELSE TRY_CAST(j ->> '$.confidence_score' AS DOUBLE) END AS confidence
    FROM checked),
flawed AS (
    SELECT *, CASE WHEN NOT is_object THEN 'The response holds no record'
        WHEN json_type(j, '$.invoice_number') NOT IN ('VARCHAR', 'NULL')
            THEN 'The response has an unusable invoice_number'
        WHEN j ->> '$.total_amount' IS NOT NULL AND amount IS NULL
            THEN 'The response has an unusable total_amount'
        WHEN NOT coalesce(confidence BETWEEN 0 AND 1, false)
            THEN 'The response has an unusable confidence_score' END AS extract_error
    FROM bound)"""

HASHED = """WITH hashed AS (
    SELECT doc_id, sha256(text) AS file_hash, text,
        row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS copy_no
    FROM documents)"""

_LABEL = "(?im)^[ \\t]*invoice[ \\t]*(number|no\\.?|#)[ \\t]*:[ \\t]*\\S"

ORACLES = {
    "scan_files": """SELECT doc_id, 'part-' AS name_begins, '.txt' AS suffix,
        strlen(coalesce(text, '')) + 1 AS length FROM documents""",
    "scanned_file_hashes": """SELECT doc_id, '.txt' AS suffix, strlen(coalesce(text, '')) + 1 AS length,
        sha256(coalesce(text, '') || chr(10)) AS file_hash FROM documents""",
    "content_hash": "SELECT doc_id, sha256(text) AS file_hash FROM documents",
    "assemble_pages": f"""SELECT conv_id, count(*) AS page_count,
        trim(string_agg(coalesce(text, ''), E'\\n\\n' ORDER BY turn), {SPACES}) AS raw_text
        FROM conversations GROUP BY conv_id""",
    "unreadable_documents": f"""SELECT doc_id,
        CASE WHEN coalesce(trim(text, {SPACES}), '') = '' THEN 'UNREADABLE_PDF' END AS issue_type
        FROM documents""",
    "decoder_fallback": f"""SELECT doc_id,
        CAST(CASE WHEN regexp_matches(text, '[^\\x00-\\x7F]') THEN 1 ELSE 0 END AS BIGINT) AS decoder,
        CAST(len(string_split(text, E'\\n')) AS BIGINT) AS page_count,
        trim(replace(text, E'\\n', E'\\n\\n'), {SPACES}) AS raw_text FROM documents""",
    "url_file_names": """SELECT page_id, string_split(url, '/')[-1] AS file_name,
        lower(regexp_extract(string_split(url, '/')[-1], '(?s).(\\.[^.]+)$', 1)) AS suffix
        FROM pages""",
    "build_request": """SELECT doc_id, 'File: doc_' || lpad(CAST(doc_id AS VARCHAR), 9, '0')
        || E'.txt\\n\\nText:\\n' || text AS request FROM documents""",
    "extract_fields_regex": LABELLED,
    "pluggable_extract": LABELLED,
    "parse_model_json": ANSWERED
    + """ SELECT seq, extract_error,
        CASE WHEN extract_error IS NULL THEN j ->> '$.invoice_number' END AS invoice_number,
        CASE WHEN extract_error IS NULL THEN j ->> '$.supplier_name' END AS supplier_name,
        CASE WHEN extract_error IS NULL THEN j ->> '$.invoice_date' END AS invoice_date,
        CASE WHEN extract_error IS NULL THEN j ->> '$.due_date' END AS due_date,
        CASE WHEN extract_error IS NULL THEN amount END AS total_amount,
        CASE WHEN extract_error IS NULL THEN j ->> '$.currency' END AS currency,
        CASE WHEN extract_error IS NULL THEN CAST(confidence AS DOUBLE) END AS confidence_score
        FROM flawed""",
    "parse_event_json": """SELECT event_id, props ->> '$.invoice_number' AS invoice_number,
        props ->> '$.supplier_name' AS supplier_name, props ->> '$.invoice_date' AS invoice_date,
        props ->> '$.due_date' AS due_date,
        TRY_CAST(props ->> '$.total_amount' AS DOUBLE) AS total_amount,
        props ->> '$.currency' AS currency,
        coalesce(TRY_CAST(props ->> '$.confidence_score' AS DOUBLE), CAST(1 AS DOUBLE))
            AS confidence_score,
        CAST(NULL AS VARCHAR) AS extract_error FROM events""",
    "extraction_failures": ANSWERED
    + """ SELECT seq, 'EXTRACTION_FAILED' AS issue_type,
        CASE WHEN seq % 11 = 3 THEN 'The document has no text to extract from'
             ELSE extract_error END AS details
        FROM flawed WHERE seq % 11 = 3 OR extract_error IS NOT NULL""",
    "parse_dates": f"""WITH {FIELDS} SELECT seq, {_date("invoice_date")} AS invoice_date,
        {_date("due_date")} AS due_date FROM orders_raw""",
    "parse_date_layouts": f"""WITH written AS (
        SELECT o_orderkey, ([strftime(o_orderdate, '%Y-%m-%d'), strftime(o_orderdate, '%Y%m%d'),
            strftime(o_orderdate, '%Y/%-m/%-d'), strftime(o_orderdate, '%-d.%-m.%Y'),
            strftime(o_orderdate, '%d/%m/%Y'), strftime(o_orderdate, '%m/%d/%Y'),
            strftime(o_orderdate, '%-d-%-m-%Y'), strftime(o_orderdate, '%-d %b %Y'),
            strftime(o_orderdate, '%d  %B %Y'), strftime(o_orderdate, '%B %-d, %Y'),
            strftime(o_orderdate, '%b %d, %Y'), strftime(o_orderdate, '%m-%d-%Y'),
            strftime(o_orderdate, '%G-W%V-%u'), strftime(o_orderdate, '%G-W%V')])
            [CAST(o_orderkey % 14 + 1 AS INTEGER)] AS text FROM orders)
        SELECT o_orderkey, text, {_date("text")} AS parsed FROM written""",
    "normalize_currency": f"""WITH {FIELDS}
        SELECT seq, {_currency("currency")} AS currency FROM orders_raw""",
    # Unicode upper case of ß is SS; this engine's upper() leaves it alone.
    "currency_in_text": f"""WITH cleaned AS (
        SELECT doc_id, text, upper(replace(trim(text, {SPACES}), 'ß', 'SS')) AS c FROM documents)
        SELECT doc_id, sha256({_currency("text", "c")}) AS code_hash FROM cleaned""",
    "clean_identifiers": f"""WITH {RAW} SELECT seq, trim(invoice_number) AS invoice_number,
        trim(supplier_name) AS supplier_name FROM raw""",
    "dedup_keys": f"""WITH {RAW} SELECT seq, lower(trim(supplier_name)) AS supplier_key,
        lower(trim(invoice_number)) AS number_key FROM raw""",
    "rule_chain": f"WITH {RAW}{JUDGED} SELECT seq, issue_type FROM judged",
    "issue_breakdown": f"""WITH {RAW}{JUDGED} SELECT coalesce(issue_type, 'PASSED') AS issue_type,
        count(*) AS documents FROM judged GROUP BY 1""",
    "review_flags": f"""WITH {RAW}{JUDGED} SELECT seq, review AS status FROM judged
        WHERE issue_type IS NULL""",
    "exact_copies": HASHED + " SELECT doc_id, file_hash, copy_no > 1 AS is_copy FROM hashed",
    "history_index": f"WITH {RAW}{LEDGER}{HISTORY} SELECT * FROM history",
    "dup_against_history": f"""WITH {RAW}{LEDGER}{HISTORY}
        SELECT r.seq FROM raw r JOIN history h ON h.supplier_key = lower(trim(r.supplier_name))
            AND h.number_key = lower(trim(r.invoice_number))
        WHERE h.n_hashes > 1 OR h.min_hash <> r.file_hash""",
    "dup_key_only": f"""WITH {RAW}{LEDGER}{HISTORY}
        SELECT r.seq FROM raw r JOIN history h ON h.supplier_key = lower(trim(r.supplier_name))
            AND h.number_key = lower(trim(r.invoice_number))""",
    "dedup_batch": FORCED + " SELECT seq, is_duplicate FROM decided WHERE issue_type IS NULL",
    "dedup_off": f"""WITH {RAW}{JUDGED} SELECT file_name,
        CASE WHEN issue_type IS NULL THEN review ELSE 'EXCEPTION' END AS status FROM judged""",
    "new_documents": f"""WITH {FIELDS}{SEEN}
        SELECT seq FROM orders_raw WHERE file_hash NOT IN (SELECT file_hash FROM seen)""",
    "already_seen": f"""WITH {FIELDS}{SEEN}
        SELECT seq FROM orders_raw WHERE file_hash IN (SELECT file_hash FROM seen)""",
    "ledger_lookup": f"""WITH {RAW}{LEDGER} SELECT o.file_hash, l.file_name, l.supplier_name,
        l.invoice_number, l.status, l.issue_type, l.processed_at
        FROM orders_raw o LEFT JOIN ledger l ON o.file_hash = l.file_hash""",
    "ledger_upsert": f"""WITH {RAW}{LEDGER}{EVENTS} SELECT file_hash, file_name, supplier_name,
        invoice_number, status, issue_type, processed_at, CAST(seq AS BIGINT) AS seq FROM latest""",
    "ledger_stats": f"""WITH {RAW}{LEDGER}{EVENTS}
        SELECT status, count(*) AS documents FROM latest GROUP BY status
        UNION ALL SELECT 'TOTAL', count(*) FROM latest""",
    "dry_run": f"""WITH {FIELDS}{SEEN}, probed AS (
        SELECT file_hash IN (SELECT file_hash FROM seen) AS known FROM orders_raw)
        SELECT count(*) AS total_documents, count(*) FILTER (WHERE NOT known) AS new_documents,
            count(*) FILTER (WHERE known) AS already_cached,
            count(*) FILTER (WHERE NOT known) AS estimated_api_calls FROM probed""",
    "ledger_lifecycle": f"""WITH {RAW}{LEDGER}
        SELECT status, count(*) AS documents, 'filled' AS phase FROM ledger GROUP BY status
        UNION ALL SELECT 'TOTAL', count(*), 'filled' FROM ledger
        UNION ALL SELECT 'TOTAL', 0, 'cleared'""",
    "validated_invoices": f"{BATCH} {INVOICES}",
    "exceptions_queue": f"{BATCH} {EXCEPTIONS}",
    "batch_results": RUN
    + """ SELECT file_name, file_hash, status, final_issue AS issue_type,
        CASE WHEN status IN ('OK', 'FLAGGED')
             THEN CAST(printf('%.2f', total_amount) AS DOUBLE) END AS total_amount,
        CASE status WHEN 'SKIPPED_CACHED' THEN 'Skipped: this content was processed before'
             WHEN 'OK' THEN 'Accepted' WHEN 'FLAGGED' THEN 'Accepted, due date needs review'
             ELSE final_details END AS message FROM outcome""",
    "run_summary": f"{RUN} {SUMMARY}",
    "text_run_summary": HASHED
    + f""", outcome AS (
        SELECT CASE WHEN copy_no > 1 THEN 'SKIPPED_CACHED' ELSE 'EXCEPTION' END AS status,
            CASE WHEN copy_no > 1 THEN 'NONE'
                 WHEN trim(text, {SPACES}) = '' THEN 'UNREADABLE_PDF'
                 WHEN regexp_matches(text, '{_LABEL}') THEN 'LABELLED'
                 ELSE 'MISSING_INVOICE_NUMBER' END AS issue_type FROM hashed)
        SELECT status, issue_type, count(*) AS documents FROM outcome GROUP BY ALL""",
    "export_invoices_projection": f"{BATCH} {INVOICES_TEXT.format(due=_DUE)}",
    "export_invoices_json": f"""{BATCH}, invoices AS ({INVOICES})
        SELECT CAST(to_json(invoices) AS VARCHAR) AS value FROM invoices""",
    # An empty CSV field reads back as null.
    "csv_round_trip": f"{BATCH} {INVOICES_TEXT.format(due=f"nullif({_DUE}, '')")}",
    "csv_round_trip_exceptions": f"{BATCH} {EXCEPTIONS}",
    "json_round_trip": f"{BATCH} {INVOICES}",
    "json_round_trip_exceptions": f"{BATCH} {EXCEPTIONS}",
    "summary_round_trip": f"{RUN} {SUMMARY}",
}

# Whole runs give what their steps give one by one.
ORACLES |= {
    "run_batch_results": ORACLES["text_run_summary"],
    "run_batch_rerun": """SELECT 'SKIPPED_CACHED' AS status, 'NONE' AS issue_type,
        count(*) AS documents FROM documents HAVING count(*) > 0""",
    "run_batch_responses": ORACLES["batch_results"],
}
