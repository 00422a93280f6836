"""Views of the given tables in the shapes the operators expect.

Each is one SELECT that Spark and DuckDB both run, so that a query and its
check start from the same rows.
"""

INTENT = (
    "case event_type when 'view' then 'general_question' when 'click' then 'transcript_request' "
    "when 'purchase' then 'certificate_request' when 'signup' then 'enrollment_letter' else 'complaint' end"
)

DRAFT_STATUS = """case concat(o_orderstatus, substring(o_orderpriority, 1, 1))
 when 'F1' then 'SENT' when 'F2' then 'REJECTED' when 'F3' then 'FAILED' when 'F4' then 'CANCELLED' when 'F5' then 'SENT'
 when 'O1' then 'APPROVED' when 'O2' then 'PENDING_APPROVAL' when 'O3' then 'DRAFT_CREATED'
 when 'O4' then 'COLLECTING_INFO' when 'O5' then 'PENDING_APPROVAL'
 when 'P1' then 'IDLE' when 'P2' then 'FAILED' when 'P3' then 'APPROVED' else 'PENDING_APPROVAL' end"""

DRAFTS = f"""select id, conversation_id, status, created_at, subject, recipient, intent_type, send_attempts,
 case when status = 'FAILED' then 'delivery failed' end as last_error, fields_enc, body,
 cast(null as string) as reviewed_by, cast(null as timestamp) as reviewed_at,
 cast(null as string) as rejection_reason
 from (select o_orderkey as id, o_custkey as conversation_id, {DRAFT_STATUS} as status,
 cast(o_orderdate as timestamp) as created_at, concat('order ', cast(o_orderkey as string)) as subject,
 concat('user', cast(o_custkey as string), '@example.org') as recipient,
 case when o_totalprice > 200000 then 'complaint' else 'transcript_request' end as intent_type,
 cast(substring(o_orderpriority, 1, 1) as int) - 1 as send_attempts,
 concat('enc', cast(o_custkey as string)) as fields_enc, concat('text of ', o_orderpriority) as body
 from {{orders}}) d"""

INCOMING = f"""select id, message_id, status, received_at, subject, sender_name, sender_hash, reply_subject,
 case when status = 'REPLIED' then received_at end as reply_sent_at,
 case when status = 'SKIPPED' and value > 20 then received_at end as deleted_at,
 intent_type, send_attempts, case when status = 'FAILED' then 'delivery failed' end as last_error,
 cast(null as string) as reviewed_by, cast(null as timestamp) as reviewed_at, cast(null as string) as admin_notes
 from (select event_id as id, concat('<m', cast(event_id as string), '@example.org>') as message_id, value,
 case event_type when 'view' then 'RECEIVED' when 'click' then 'PENDING_REVIEW' when 'purchase' then 'REPLIED'
 when 'signup' then 'SKIPPED' else case when value > 20 then 'FAILED' else 'APPROVED' end end as status,
 cast(ts as timestamp) as received_at, concat('mail ', cast(event_id as string)) as subject,
 case when event_type in ('view', 'purchase') then concat('User ', cast(user_id as string)) end as sender_name,
 md5(concat('user', cast(user_id as string))) as sender_hash,
 case when event_type = 'purchase' then concat('Re: mail ', cast(event_id as string)) end as reply_subject,
 {INTENT} as intent_type, 0 as send_attempts from {{events}}) i"""

INTENTS = f"""select event_id as id, user_id as conversation_id, {INTENT} as intent_type,
 cast(ts as timestamp) as detected_at from {{events}}"""

LOGS = """select o_orderkey as id, cast(o_orderdate as timestamp) as sent_at,
 case when o_orderstatus = 'P' then cast(o_orderdate as timestamp) end as deleted_at, o_orderpriority as subject
 from {orders}"""

DOCS = """select doc_id, text, lang, source, n_chars,
 case lang when 'en' then 'INDEXED' when 'fr' then 'PENDING' when 'de' then 'FAILED' else 'PROCESSING' end as status,
 case when source in ('src1', 'src7') then timestamp '2024-01-01 00:00:00' end as deleted_at,
 case when lang = 'es' then 'text/plain' else 'application/pdf' end as mime_type from {documents}"""

# Documents with personal data of every class added to their text.
PII_DOCS = """select doc_id, lang, source, concat(text, ' kimlik ', cast(10000000000 + doc_id as string),
 ' tel +90 532 ', substring(cast(1000 + doc_id % 1000 as string), 2, 3), ' 45 67 posta user', cast(doc_id as string),
 '@example.org imza Mehmet Demir Kaya') as text from {documents}"""

NOW_EVENTS = "2024-01-30 00:00:00"
NOW_ORDERS = "2001-08-01 00:00:00"
