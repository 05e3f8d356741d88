"""Registered retrieval queries and the SQL they are held against."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from ..functions import identity, scalar, snippets, text
from ..functions.access import Filters, visible, visible_public
from ..operators import chunking, evaluation, retrieval
from ..operators.lexindex import LexicalIndex
from ..sources.shared import shared_folder
from ..sources.tables import EMBEDDINGS_SQL, NOW, UNITS_SQL, table, unit_embeddings, units

WORDS = ["the and", "that with for", "les des", "und der", '"of the"', "the -and", "the or und"]
VECTORS = (0, 7, 19)

_POST = """post as (select unit_id, unnest(toks) as t from (select unit_id, list_transform(range(len(all_)), lambda i: {'pos': i::int, 'term': all_[i + 1].term, 'weight': all_[i + 1].weight}) as toks
  from (select unit_id, list_concat(
    list_transform(regexp_extract_all(lower(title), '[\\p{L}\\p{N}_]+'), lambda x: {'term': x, 'weight': 1.0::double}),
    list_transform(regexp_extract_all(lower(concat_ws(' ', source_area, topic, channel, author)), '[\\p{L}\\p{N}_]+'), lambda x: {'term': x, 'weight': 0.4::double}),
    list_transform(regexp_extract_all(lower(content), '[\\p{L}\\p{N}_]+'), lambda x: {'term': x, 'weight': 0.2::double})) as all_ from units)))"""


def _lexical_sql(queries: dict[str, list[str]]) -> str:
    """AND queries: cover density in plain joins and groups."""
    wanted = ", ".join(f"('{q}', '{w}', {len(ws)})" for q, ws in queries.items() for w in ws)
    return f"""{UNITS_SQL}, {_POST},
wanted(query, term, n) as (values {wanted}),
hits as materialized (select w.query, w.n, p.unit_id, p.t.pos as pos, p.t.term as term, p.t.weight as weight from post p join wanted w on w.term = p.t.term),
ok as (select query, unit_id from hits group by query, unit_id, n having count(distinct term) = n),
h as materialized (select hits.* from hits join ok using (query, unit_id)),
last as (select e.query, e.unit_id, e.n, e.pos as b, o.term, max(o.pos) as m, arg_max(o.weight, o.pos) as weight from h e join h o on e.query = o.query and e.unit_id = o.unit_id and o.pos <= e.pos group by all),
cov as (select query, unit_id, b, min(m) as a, avg(weight) as weight from last group by query, unit_id, b, n having count(*) = n),
w as (select query, unit_id, a, min(b) as b, arg_min(weight, b) as weight from cov group by query, unit_id, a),
density as (select query, unit_id, sum(weight / (b - a + 1)) / (sum(weight / (b - a + 1)) + 1) as density from w group by query, unit_id)"""


AUTHORITY_SQL = "case u.authority when 'approved_operational' then 0.35 when 'article_source' then 0.20 when 'governance' then 0.20 when 'committee_record' then 0.10 when 'meeting_transcript' then 0.08 when 'meeting_summary' then 0.03 else 0.0 end::double"
_SCORE = f"""round(density + case when lower(u.title) = lower(query) then 2.0 else 0.0 end + case when contains(lower(u.title), lower(query)) then 0.35 else 0.0 end
  + {AUTHORITY_SQL} + case when u.is_current then 0.15 else 0.0 end, 6)"""
_OPEN = "u.source_type not in ('document', 'slack_message', 'meeting_transcript', 'meeting_summary', 'meeting_notes') and u.review_status = 'approved' and not u.is_stale and not u.is_deleted"


def _scope_sql(scope: str) -> str:
    sees = {"public": "'public'", "member": "'public', 'member'", "committee": "'public', 'member', 'committee'"}
    return "true" if scope == "admin" else f"{_OPEN} and u.visibility in ({sees[scope]})"


_INDEXES: dict[tuple[str, str], LexicalIndex] = {}


def index(spark, folder) -> LexicalIndex:
    """The kept index of the folder's units: built by the first query of an application that asks for it."""
    key = spark.sparkContext.applicationId, folder
    if key not in _INDEXES:
        _INDEXES[key] = LexicalIndex.build(units(spark, folder), f"{shared_folder(spark)}/tarn-lexical-{uuid.uuid4().hex}")
    return _INDEXES[key]


def lexical_index(spark, folder):
    """The dictionary of the kept index: in how many units each term stands."""
    return index(spark, folder).terms.select("term", "documents")


INDEX_SQL = f"""with {UNITS_SQL}, {_POST} select t.term as term, count(distinct unit_id) as documents from post group by all"""

AND_QUERIES = {"the and": ["the", "and"], "that with for": ["that", "with", "for"], "les des": ["les", "des"], "und der": ["und", "der"]}


def lexical_search(spark, folder):
    queries = [text.parse_query(q) for q in AND_QUERIES]
    out = index(spark, folder).search(queries, "committee", limit=20)
    return out.select("query", "unit_id", "score", "lexical_rank")


LEXICAL_SQL = f"""with {_lexical_sql(AND_QUERIES)},
r as (select query, u.unit_id, {_SCORE} as score, u.occurred_at from density join units u using (unit_id) where u.is_current and {_scope_sql("committee")}),
k as (select query, unit_id, score, row_number() over (partition by query order by score desc, occurred_at desc, unit_id)::int as lexical_rank from r)
select * from k where lexical_rank <= 20"""


def lexical_recency(spark, folder):
    """The same search with the recency of chat messages in the score, history included."""
    queries = [text.parse_query(q) for q in AND_QUERIES]
    out = index(spark, folder).search(queries, "admin", Filters(include_history=True), limit=30, now=NOW)
    return out.select("query", "unit_id", "score", "lexical_rank")


_RECENT = _SCORE.rsplit(", 6)", 1)[0] + """
  + case when u.source_type = 'slack_message' then greatest(0.0, 0.05 * (1 - (epoch_us(timestamp '2024-02-01') - epoch_us(occurred_at)) / 86400000000.0::double / 365.0)) else 0.0 end, 6)"""
LEXICAL_RECENCY_SQL = f"""with {_lexical_sql(AND_QUERIES)},
r as (select query, u.unit_id, {_RECENT} as score, u.occurred_at from density join units u using (unit_id)),
k as (select query, unit_id, score, row_number() over (partition by query order by score desc, occurred_at desc, unit_id)::int as lexical_rank from r)
select * from k where lexical_rank <= 30"""


def web_search(spark, folder):
    """Phrases, alternatives and unwanted words; every match, unranked."""
    queries = [text.parse_query(q) for q in WORDS]
    return index(spark, folder).matched(queries).select("query", "unit_id")


WEB_SQL = f"""with {UNITS_SQL}, t as (select unit_id, ' ' || array_to_string(list_concat(regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}_]+'),
  regexp_extract_all(lower(concat_ws(' ', source_area, topic, channel, author)), '[\\p{{L}}\\p{{N}}_]+'), regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}_]+')), ' ') || ' ' as s from units),
m as (select 'the and' as query, unit_id from t where contains(s, ' the ') and contains(s, ' and ')
union all select 'that with for', unit_id from t where contains(s, ' that ') and contains(s, ' with ') and contains(s, ' for ')
union all select 'les des', unit_id from t where contains(s, ' les ') and contains(s, ' des ')
union all select 'und der', unit_id from t where contains(s, ' und ') and contains(s, ' der ')
union all select '"of the"', unit_id from t where contains(s, ' of the ')
union all select 'the -and', unit_id from t where contains(s, ' the ') and not contains(s, ' and ')
union all select 'the or und', unit_id from t where contains(s, ' the ') or contains(s, ' und ')) select * from m"""


def search_snippets(spark, folder):
    """The lexical hits of two words with two fragments of their whole texts."""
    query = text.parse_query("the and")
    hits = index(spark, folder).search([query], "admin", limit=50).select("query", "unit_id", "lexical_rank")
    return hits.join(units(spark, folder).select("unit_id", "content"), "unit_id").select("query", "unit_id", "lexical_rank", snippets.snippet(list(query.words))("content").alias("snippet"))


def lexical_multi_query(spark, folder):
    """Rank lists of several phrasings, summed per unit."""
    queries = [text.parse_query(q) for q in AND_QUERIES]
    kept = index(spark, folder)
    return retrieval.rank_sums(kept.matched(queries, kept.units.where(visible_public())))


LEXICAL_MULTI_SQL = f"""with {_lexical_sql(AND_QUERIES)},
r as (select query, unit_id, row_number() over (partition by query order by round(density, 6) desc, unit_id) as r from density join units u using (unit_id) where u.is_current and {_scope_sql("public")})
select unit_id, round(sum(1.0::double / (60 + r)), 9) as lexical_score, min(r)::int as best_rank, count(*) as matched_queries from r group by unit_id"""


def title_boost_ilike(spark, folder):
    return retrieval.substring_search(units(spark, folder), "tion the", 50).select("unit_id", F.col("score").cast("int").alias("score"))


ILIKE_SQL = f"""with {UNITS_SQL} select unit_id, (case when title ilike '%tion the%' then 2 else 0 end + case when content ilike '%tion the%' then 1 else 0 end)::int as score
from units where title ilike '%tion the%' or content ilike '%tion the%' order by score desc, unit_id limit 50"""


def _scope(scope):
    return lambda spark, folder: units(spark, folder).where(visible(scope) & Filters().column()).select("unit_id", "source_type", "visibility")


def _scope_query(scope):
    return f"with {UNITS_SQL} select unit_id, source_type, visibility from units u where u.is_current and {_scope_sql(scope)}"


def time_range_filter(spark, folder):
    f = Filters(from_time=datetime(2024, 1, 10), to_time=datetime(2024, 1, 20), topic="en")
    return units(spark, folder).where(f.column()).select("unit_id", "occurred_at")


def source_type_in(spark, folder):
    f = Filters(source_types=("article", "document"), area="src4", include_history=True)
    return units(spark, folder).where(f.column()).select("unit_id", "source_type")


def _asked(spark, folder, name: str | None = None):
    """The stated query vectors: three of the table's, or the first of them under another name."""
    e = unit_embeddings(spark, folder)
    wanted = VECTORS if name is None else VECTORS[:1]
    rows = e.where(F.col("unit_id").isin(*(f"{v:08d}" for v in wanted))).select("unit_id", "embedding").collect()
    return [(name or r.unit_id, r.embedding) for r in rows]


def semantic_topk(spark, folder):
    e = unit_embeddings(spark, folder).where("model = 'base'").select("unit_id", "embedding")
    out = retrieval.semantic(units(spark, folder), e, _asked(spark, folder), "admin", limit=20)
    return out.select("query", "unit_id", "similarity", "semantic_rank")


_SIM = f"""asked as (select unit_id as query, embedding as v from unit_embeddings where unit_id in ({", ".join(f"'{v:08d}'" for v in VECTORS)})),
sim as (select query, u.unit_id, round(list_inner_product(e.embedding::double[], v::double[]) / (sqrt(list_inner_product(e.embedding::double[], e.embedding::double[])) * sqrt(list_inner_product(v::double[], v::double[]))), 6) as similarity
  from units u join unit_embeddings e using (unit_id) cross join asked where e.model = 'base' and u.is_current)"""
SEMANTIC_SQL = f"""with {UNITS_SQL}, {EMBEDDINGS_SQL}, {_SIM},
k as (select query, unit_id, similarity, row_number() over (partition by query order by similarity desc, unit_id)::int as semantic_rank from sim) select * from k where semantic_rank <= 20"""


def semantic_floor_pool(spark, folder):
    e = unit_embeddings(spark, folder).where("model = 'base'").select("unit_id", "embedding")
    return retrieval.semantic(units(spark, folder), e, _asked(spark, folder), "admin", limit=80, floor=0.10).select("query", "unit_id", "similarity")


SEMANTIC_FLOOR_SQL = f"""with {UNITS_SQL}, {EMBEDDINGS_SQL}, {_SIM},
k as (select query, unit_id, similarity, row_number() over (partition by query order by similarity desc, unit_id) as r from sim where similarity >= 0.10) select query, unit_id, similarity from k where r <= 80"""


def _lists(spark, folder):
    """Two ranked lists for one question: a word query and a vector."""
    u = index(spark, folder).units
    words = index(spark, folder).search([text.parse_query("the and")], "admin", limit=60)
    e = unit_embeddings(spark, folder).where("model = 'base'").select("unit_id", "embedding")
    return u, words, retrieval.semantic(u, e, _asked(spark, folder, "the and"), "admin", limit=60)


def rrf_fusion(spark, folder):
    u, words, near = _lists(spark, folder)
    return retrieval.fused(words, near, u, 20, semantic_weight=2.0)


_LISTS = f"""{_lexical_sql({"the and": ["the", "and"]})}, {EMBEDDINGS_SQL}, {_SIM},
lr as (select u.unit_id, {_SCORE} as score, u.occurred_at from density join units u using (unit_id) where u.is_current),
lx as (select unit_id, row_number() over (order by score desc, occurred_at desc, unit_id)::int as lexical_rank from lr qualify lexical_rank <= 60),
sx as (select unit_id, row_number() over (order by similarity desc, unit_id)::int as semantic_rank from sim where query = '{VECTORS[0]:08d}' qualify semantic_rank <= 60)"""
RRF_SQL = f"""with {_LISTS},
f as (select unit_id, lexical_rank, semantic_rank, round(coalesce(1.0::double / (60 + lexical_rank), 0) + coalesce(2.0::double / (60 + semantic_rank), 0)
  + case u.authority when 'approved_operational' then 0.012 when 'article_source' then 0.008 when 'governance' then 0.008 else 0.0 end::double + case when u.is_current then 0.004 else 0.0 end::double, 9) as score
  from lx full join sx using (unit_id) join units u using (unit_id))
select 'the and' as query, *, row_number() over (order by score desc, unit_id)::int as rank from f qualify rank <= 20"""


def exact_rescue_union(spark, folder):
    """A query that names an identifier: titles that hold it lead the vector list."""
    _, _, near = _lists(spark, folder)
    words = index(spark, folder).search([text.parse_query("THE")], "admin", limit=10)
    q = F.lit("THE")
    return retrieval.rescued(words.withColumn("query", q), near.withColumn("query", q), 30)


RESCUE_SQL = f"""with {_lexical_sql({"THE": ["the"]})}, {EMBEDDINGS_SQL}, {_SIM},
lr as (select u.unit_id, u.title, {_SCORE} as score, u.occurred_at from density join units u using (unit_id) where u.is_current),
lx as (select unit_id, title, row_number() over (order by score desc, occurred_at desc, unit_id) as pl from lr qualify pl <= 10),
sx as (select unit_id, row_number() over (order by similarity desc, unit_id) as pl from sim where query = '{VECTORS[0]:08d}' qualify pl <= 60),
b as (select unit_id, 0 as part, pl from lx where contains(lower(title), 'the') union all select unit_id, 1, pl from sx),
m as (select unit_id, min(struct_pack(part := part, pl := pl)) as p from b group by unit_id)
select 'THE' as query, unit_id, p.part = 0 as rescued, row_number() over (order by p.part, p.pl, unit_id)::int as rank from m qualify rank <= 30"""


def rrf_multi_query(spark, folder):
    u = index(spark, folder).units.where(visible("admin"))
    queries = [text.parse_query(q) for q in retrieval.phrasings(["The and", " the AND ", "", "les des"])]
    hits = index(spark, folder).matched(queries, u).withColumn("density", scalar.rounded(F.col("density"), 6))
    e = unit_embeddings(spark, folder).where("model = 'base'").select("unit_id", "embedding")
    pool = retrieval.semantic(u, e, _asked(spark, folder, "vector"), "admin", Filters(include_history=True), limit=80, floor=0.05).select("unit_id", "similarity")
    return retrieval.multi_query(u, hits, pool, limit=20)


MULTI_SQL = f"""with {_lexical_sql({"the and": ["the", "and"], "les des": ["les", "des"]})}, {EMBEDDINGS_SQL},
r as (select query, unit_id, row_number() over (partition by query order by round(density, 6) desc, unit_id) as r from density),
lf as (select unit_id, sum(1.0::double / (60 + r)) as ls, min(r)::int as best, count(*) as mq from r group by unit_id),
v as (select embedding as v from unit_embeddings where unit_id = '{VECTORS[0]:08d}'),
sim as (select u.unit_id, round(list_inner_product(e.embedding::double[], v::double[]) / (sqrt(list_inner_product(e.embedding::double[], e.embedding::double[])) * sqrt(list_inner_product(v::double[], v::double[]))), 6) as similarity
  from units u join unit_embeddings e using (unit_id) cross join v where e.model = 'base'),
sp as (select unit_id, similarity, row_number() over (order by similarity desc, unit_id)::int as semantic_rank from sim where similarity >= 0.05 qualify semantic_rank <= 80)
select unit_id, coalesce(similarity, 0.0) as similarity, coalesce(best, 2147483647) as best_lexical_rank, semantic_rank, coalesce(mq, 0) as matched_queries,
  round(coalesce(ls, 0) + coalesce(1.0::double / (60 + semantic_rank), 0), 9) as fused_score, {AUTHORITY_SQL} as authority_weight
from lf full join sp using (unit_id) join units u using (unit_id) order by fused_score desc, authority_weight desc, u.occurred_at desc, unit_id limit 20"""


def embedding_profile(spark, folder):
    return retrieval.dominant_model(unit_embeddings(spark, folder), ("none", "none", "0", 0))


PROFILE_SQL = f"""with {EMBEDDINGS_SQL} select provider, model, model_version, dimension, count(*) as embedded from unit_embeddings group by all order by embedded desc, all limit 1"""
PROFILE_SQL = PROFILE_SQL.replace(", all limit 1", ", provider, model, model_version, dimension limit 1")


def _eligible():
    return evaluation.embedding_eligible(("article", "knowledge_requirement", "operational_action", "document"), areas=("src1", "src2", "src3"))


_ELIGIBLE_SQL = """(source_type in ('article', 'knowledge_requirement', 'operational_action', 'document') and is_current and not is_stale and not is_deleted and trim(coalesce(content, '')) <> ''
  and not regexp_matches(coalesce(title, ''), '(?i)(^|[/\\\\])(\\.env(\\..*)?|.*\\.(pem|key|p12|pfx)|id_(rsa|dsa|ecdsa|ed25519)|.*(password|secret|credential|token).*)$')
  and case when source_type like 'operational%' then coalesce(review_status = 'approved', false) when source_type = 'document' then lower(coalesce(source_area, '')) in ('src1', 'src2', 'src3') else true end)"""
_INPUT_SQL = """('Title: ' || title || chr(10) || 'Source type: ' || source_type || case when coalesce(source_area, '') <> '' then chr(10) || 'Area: ' || source_area else '' end || case when coalesce(topic, '') <> '' then chr(10) || 'Topic: ' || topic else '' end
  || case when coalesce(channel, '') <> '' then chr(10) || 'Channel: ' || channel else '' end || chr(10) || 'Content:' || chr(10) || trim(content))"""


def _hashed(spark, folder):
    """Embeddings with the hash of what was embedded; one unit in eight has changed since."""
    u = units(spark, folder)
    h = F.sha2(F.concat(evaluation.embedding_input(), F.when(F.col("unit_id").cast("int") % 8 == 1, "!").otherwise("")), 256)
    return unit_embeddings(spark, folder).join(u.select("unit_id", h.alias("input_hash")), "unit_id")


_HASHED_SQL = f"""hashed as (select e.unit_id, e.model, sha256({_INPUT_SQL} || case when u.unit_id::int % 8 = 1 then '!' else '' end) as input_hash from unit_embeddings e join units u on u.unit_id = e.unit_id)"""


def embedding_coverage(spark, folder):
    return evaluation.coverage(units(spark, folder), _hashed(spark, folder), _eligible(), "base")


COVERAGE_SQL = f"""with {UNITS_SQL}, {EMBEDDINGS_SQL}, {_HASHED_SQL},
p as (select unit_id, max(case when model = 'base' then input_hash end) as h, bool_or(model <> 'base') as o from hashed group by unit_id)
select source_area, source_type, case when not {_ELIGIBLE_SQL} then 'excluded' when h is null then case when o then 'other_model' else 'missing' end when h <> sha256({_INPUT_SQL}) then 'stale' else 'embedded' end as status, count(*) as units
from units left join p using (unit_id) group by all"""


def embedding_worklist(spark, folder):
    return evaluation.worklist(units(spark, folder), _hashed(spark, folder), _eligible(), "base")


WORKLIST_SQL = f"""with {UNITS_SQL}, {EMBEDDINGS_SQL}, {_HASHED_SQL}
select unit_id, sha256({_INPUT_SQL}) as input_hash, greatest(1, length({_INPUT_SQL}) // 4)::int as tokens from units u
where {_ELIGIBLE_SQL} and not exists (select 1 from hashed h where h.unit_id = u.unit_id and h.model = 'base' and h.input_hash = sha256({_INPUT_SQL}))"""


def stable_keys_sha(spark, folder):
    u = units(spark, folder)
    key = identity.stable_key(F.col("source_type"), F.col("source_record_id"), F.col("source_version_id"), F.col("chunk_index"))
    return u.select("unit_id", key.alias("stable_key"), identity.unit_id(key).alias("uuid"), identity.fingerprint(F.col("title"), F.col("author"), F.col("topic")).alias("fingerprint"))


STABLE_SQL = f"""with {UNITS_SQL}, k as (select unit_id, concat_ws(':', source_type, source_record_id, source_version_id, chunk_index::varchar) as stable_key, title, topic from units),
h as (select *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('tarn-unit:' || stable_key)) as h from k)
select unit_id, stable_key, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || lower(to_hex(8 + ('0x' || substr(h, 17, 1))::int % 4)) || substr(h, 18, 3) || '-' || substr(h, 21, 12) as uuid,
  sha256(coalesce(title, '') || chr(31) || '' || chr(31) || coalesce(topic, '')) as fingerprint from h"""


def index_diff(spark, folder):
    """The index before: some units with other hashes, some not yet there, some no longer rebuilt."""
    u = units(spark, folder).select("unit_id", "is_current", F.sha2("content", 256).alias("index_hash"))
    n = F.col("unit_id").cast("int")
    old = u.where(n % 6 != 1).select(F.col("unit_id").alias("stable_key"), F.when(n % 5 == 0, "x").otherwise(F.col("index_hash")).alias("index_hash"), "is_current")
    new = u.where(n % 7 != 2).select(F.col("unit_id").alias("stable_key"), "index_hash")
    return chunking.index_diff(old, new)


INDEX_DIFF_SQL = f"""with {UNITS_SQL},
o as (select unit_id, is_current as c, case when unit_id::int % 5 = 0 then 'x' else sha256(content) end as h from units where unit_id::int % 6 <> 1),
n as (select unit_id, sha256(content) as h from units where unit_id::int % 7 <> 2),
d as (select unit_id as stable_key, case when o.h is null then 'created' when n.h is null then case when c then 'retired' end when o.h <> n.h or not c then 'updated' else 'unchanged' end as change from o full join n using (unit_id))
select * from d where change is not null"""


def chunks(spark, folder):
    d = table(spark, folder, "documents")
    rows = d.select(F.col("doc_id").alias("record_id"), F.sha2("text", 256).alias("version_id"), F.substring("text", 1, 80).alias("title"), F.col("text").alias("content"), F.col("source").alias("source_area"))
    return chunking.make_units(rows, F.lit("document")).select("unit_id", "stable_key", "record_id", "chunk_index", "content_hash", "index_hash", F.length("content").alias("n_chars"))


def unit_union(spark, folder):
    """Documents, pages and conversations as units of one shape."""
    d = table(spark, folder, "documents").select(F.lit("document").alias("source_type"), F.col("doc_id").cast("string").alias("record_id"), F.substring("text", 1, 80).alias("title"), F.sha2("text", 256).alias("content_hash"))
    p = table(spark, folder, "pages").select(F.lit("article").alias("source_type"), F.col("page_id").cast("string").alias("record_id"), F.col("url").alias("title"), F.sha2("html", 256).alias("content_hash"))
    c = table(spark, folder, "conversations").select(F.lit("slack_message").alias("source_type"), F.concat_ws(".", "conv_id", "turn").alias("record_id"), F.col("role").alias("title"), F.sha2("text", 256).alias("content_hash"))
    return d.unionByName(p).unionByName(c)


UNION_SQL = """select 'document' as source_type, doc_id::varchar as record_id, substr(text, 1, 80) as title, sha256(text) as content_hash from documents
union all select 'article', page_id::varchar, url, sha256(html) from pages union all select 'slack_message', conv_id::varchar || '.' || turn::varchar, role, sha256(text) from conversations"""


def per_parent_cap(spark, folder):
    u, words, _ = _lists(spark, folder)
    ranked = words.select("query", "unit_id", "source_type", "source_record_id", "source_parent_id", F.col("lexical_rank").alias("rank"))
    return evaluation.parent_cap(ranked).select("query", "unit_id", "rank")


CAP_SQL = f"""with {_LISTS}, c as (select unit_id, lexical_rank, row_number() over (partition by source_type, case when source_type = 'document' then source_record_id else source_parent_id end order by lexical_rank) as n from lx join units using (unit_id))
select 'the and' as query, unit_id, row_number() over (order by lexical_rank)::int as rank from c where n <= 2"""


def context_package(spark, folder):
    u, words, near = _lists(spark, folder)
    rows = retrieval.fused(words, near, u, 20, 2.0).join(u.select("unit_id", "source_type"), "unit_id")
    return retrieval.context_package(rows)


CONTEXT_SQL = f"""with {RRF_SQL[5:].rsplit("select 'the and' as query", 1)[0].rstrip()},
k as (select *, row_number() over (order by score desc, unit_id) as rank from f qualify rank <= 20)
select 'the and' as query, count(*) as result_count, count(distinct u.source_type) as source_family_count, max(case when rank = 1 then score end) as top_score,
  round(max(case when rank = 1 then score end) - max(case when rank = 2 then score end), 9) as rank_gap, bool_or(coalesce(lexical_rank = 1, false) and semantic_rank is null) as exact_lexical_match,
  case when count(*) = 1 then 'limited' else 'normal' end as retrieval_quality from k join units u using (unit_id)"""


def recency_decay(spark, folder):
    u = units(spark, folder)
    return u.select("unit_id", F.round(scalar.recency(F.col("occurred_at"), NOW, 30.0), 6).alias("score"))


RECENCY_SQL = f"""with {UNITS_SQL} select unit_id, round(greatest(0.0, 1 - (epoch_us(timestamp '2024-02-01') - epoch_us(occurred_at)) / 86400000000.0 / 30.0), 6) as score from units"""

QUERIES = {
    "lexical_index": (lexical_index, INDEX_SQL),
    "lexical_search": (lexical_search, LEXICAL_SQL),
    "lexical_recency": (lexical_recency, LEXICAL_RECENCY_SQL),
    "web_search_syntax": (web_search, WEB_SQL),
    "lexical_multi_query": (lexical_multi_query, LEXICAL_MULTI_SQL),
    "search_snippets": (search_snippets, None),
    "title_boost_ilike": (title_boost_ilike, ILIKE_SQL),
    **{f"scope_{s}": (_scope(s), _scope_query(s)) for s in ("public", "member", "committee", "admin")},
    "time_range_filter": (time_range_filter, f"with {UNITS_SQL} select unit_id, occurred_at from units where is_current and topic = 'en' and occurred_at >= timestamp '2024-01-10' and occurred_at < timestamp '2024-01-20'"),
    "source_type_in": (source_type_in, f"with {UNITS_SQL} select unit_id, source_type from units where source_type in ('article', 'document') and source_area = 'src4'"),
    "semantic_topk": (semantic_topk, SEMANTIC_SQL),
    "semantic_floor_pool": (semantic_floor_pool, SEMANTIC_FLOOR_SQL),
    "rrf_fusion": (rrf_fusion, RRF_SQL),
    "rrf_multi_query": (rrf_multi_query, MULTI_SQL),
    "exact_rescue_union": (exact_rescue_union, RESCUE_SQL),
    "embedding_profile": (embedding_profile, PROFILE_SQL),
    "embedding_coverage": (embedding_coverage, COVERAGE_SQL),
    "embedding_worklist": (embedding_worklist, WORKLIST_SQL),
    "unit_union": (unit_union, UNION_SQL),
    "stable_keys_sha": (stable_keys_sha, STABLE_SQL),
    "index_diff": (index_diff, INDEX_DIFF_SQL),
    "chunks": (chunks, None),
    "per_parent_cap": (per_parent_cap, CAP_SQL),
    "context_package": (context_package, CONTEXT_SQL),
    "recency_decay": (recency_decay, RECENCY_SQL),
}
