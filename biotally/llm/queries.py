"""Registered queries of this subpackage, each over its whole tables, and their oracle texts where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biotally.llm.centroids import CLUSTERS, ROUNDS, cluster
from biotally.llm.chat import prefix_forest, probe_turns, read_back
from biotally.llm.decontam import find_leaks
from biotally.llm.html_main import extract
from biotally.llm.line_dedup import removed_spans
from biotally.llm.mixing import mix
from biotally.llm.pii import find_personal_data
from biotally.llm.quality_model import grade_documents
from biotally.llm.quality_rules import quality_rules
from biotally.llm.simhash import simhash_components
from biotally.llm.toxicity import score_toxicity
from biotally.llm.vector_dedup import vector_components
from biotally.llm.whitening import whiten
from biotally.llm.words import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read_table(spark, sf_dir, "documents"))


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lang", "source", "distance")


@query
def op2_chat_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    forest, leaves = prefix_forest(turns.unionByName(probe_turns(spark)))
    return read_back(forest, leaves).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


# Escaping and template of the formatted turn, in SQL: a backslash before each backslash and control string.
ORACLES["op2_chat_prefix_tree"] = r"""
with turns as (
  select conv_id, turn, role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t as (
  select conv_id, turn, coalesce(role, '') as role, text,
    length(coalesce(role, '')) + length(regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g')) + 15 as formatted
  from turns)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(formatted) as bigint) as formatted_chars
from t group by conv_id
"""


@query
def op5_line_block_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))


@query
def op6_entropy_balancing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mix(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return rows.select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


@query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_spans(read_table(spark, sf_dir, "documents"))


# Lines, then sentences of lines with several; chr(1) marks the cuts. Offsets are running lengths.
ORACLES["op8_line_dedup"] = r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as piece, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as k from documents),
placed as (
  select doc_id, piece, k, cast(coalesce(sum(length(piece) + 1) over (partition by doc_id order by k rows between unbounded preceding and 1 preceding), 0) as bigint) as line_start from lines),
cuts as (
  select doc_id, line_start, unnest(string_split(regexp_replace(piece, '([.!?]) ', '\1 ' || chr(1), 'g'), chr(1))) as part,
    generate_subscripts(string_split(regexp_replace(piece, '([.!?]) ', '\1 ' || chr(1), 'g'), chr(1)), 1) as j,
    len(string_split(regexp_replace(piece, '([.!?]) ', '\1 ' || chr(1), 'g'), chr(1))) as parts
  from placed),
sentences as (
  select doc_id, line_start, part, parts, cast(line_start + coalesce(sum(length(part)) over (partition by doc_id, line_start order by j rows between unbounded preceding and 1 preceding), 0) as bigint) as start_char from cuts),
units as (
  select doc_id, 0 as level, line_start, line_start as start_char, line_start + length(piece) as end_char, piece as raw from placed
  union all select doc_id, 1, line_start, start_char, start_char + length(part), part from sentences where parts > 1 and part <> ''),
normal as (
  select doc_id, level, line_start, start_char, end_char, regexp_extract_all(raw, '[^\x20\x09-\x0D]+') as words from units),
keyed as (
  select doc_id, level, line_start, start_char, end_char, lower(array_to_string(words, ' ')) as key from normal where len(words) >= 5),
ranked as (
  select *, first_value(doc_id) over w as first_doc_id, first_value(start_char) over w as first_start from keyed window w as (partition by key order by doc_id nulls last, start_char)),
later as (select * from ranked where not (doc_id is not distinct from first_doc_id and start_char = first_start))
select doc_id, start_char, end_char, level, first_doc_id, first_start from later
where level = 0 or not exists (select 1 from later l where l.level = 0 and l.doc_id is not distinct from later.doc_id and l.line_start = later.line_start)
"""

# The pages of these tables mark their article and use five tags in it; the operator itself does without such a rule.
ORACLES["op5_line_block_extraction"] = r"""
with body as (
  select page_id, url, string_split(regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'), '</?b>', '', 'g'), '</?(p|h1|br)>', chr(10), 'g'), chr(10)) as parts from pages),
decoded as (
  select page_id, url, list_filter(list_transform(parts, lambda x: trim(regexp_replace(replace(replace(replace(replace(x, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g'))), lambda x: x <> '') as parts from body)
select page_id, url, array_to_string(parts, chr(10)) as text, length(array_to_string(parts, chr(10))) as n_chars from decoded
"""


@query
def op7_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grade_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query
def op10_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query
def op3_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(read_table(spark, sf_dir, "documents"))


@query
def op4_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query
def op11_small_world_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_components(read_table(spark, sf_dir, "embeddings"))


# Every two vectors of a label, and all that links reach.
ORACLES["op11_small_world_near_duplicates"] = """
with recursive usable as (
  select vec_id, label, cast(embedding as double[]) as v from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs as (
  select a.vec_id as a, b.vec_id as b from usable a join usable b on a.label = b.label and a.vec_id < b.vec_id and len(a.v) = len(b.v)
  where list_cosine_similarity(a.v, b.v) >= 0.93),
links as (select a, b from pairs union all select b, a from pairs),
reach as (select vec_id as a, vec_id as b from embeddings union select r.a, l.b from reach r join links l on r.b = l.a),
least as (select a, min(b) as component_id from reach group by a),
degree as (select a, count(*) as n from links group by a)
select vec_id, coalesce(n, 0) as n_links, component_id, vec_id = component_id as kept
from embeddings join least on vec_id = least.a left join degree on vec_id = degree.a
"""


@query
def op12_bit_sliced_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whiten(read_table(spark, sf_dir, "embeddings"))
    return rows.withColumn("deviation", F.expr("try_cast(deviation as long)"))


@query
def op13_orchard_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(read_table(spark, sf_dir, "embeddings"))


def _lloyd_sql() -> str:
    """Every vector against every centroid, round by round."""
    far = "list_sum(list_transform(list_zip(k.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    nearest = f"select k.vec_id, k.x, c.cluster, {far} as distance from kept k cross join {{0}} c qualify row_number() over (partition by k.vec_id order by {far}, c.cluster) = 1"
    out = [
        "with kept as (select vec_id, list_transform(embedding, lambda v: cast(floor(64 * cast(v as double)) as bigint)) as x from embeddings"
        " where len(embedding) = 64 and len(list_filter(embedding, lambda v: v is null or isnan(v) or isinf(v))) = 0)",
        f"c0 as (select row_number() over (order by sha256('1:' || vec_id)) - 1 as cluster, x from kept order by sha256('1:' || vec_id) limit {CLUSTERS})",
    ]
    for r in range(ROUNDS):
        out.append(f"a{r} as ({nearest.format(f'c{r}')})")
        out.append(f"u{r} as (select cluster, unnest(x) as v, generate_subscripts(x, 1) as i from a{r})")
        out.append(f"m{r} as (select cluster, i, cast((sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*) as bigint) as v from u{r} group by cluster, i)")
        out.append(f"n{r} as (select cluster, list(v order by i) as x from m{r} group by cluster)")
        out.append(f"c{r + 1} as (select c{r}.cluster, coalesce(n{r}.x, c{r}.x) as x from c{r} left join n{r} on c{r}.cluster = n{r}.cluster)")
    out.append(f"final as ({nearest.format(f'c{ROUNDS}')})")
    return (
        ",\n".join(out)
        + f"""
select f.vec_id, cast(f.cluster as integer) as cluster, cast(f.distance as bigint) as distance, cast(sum(f.distance) over (partition by f.cluster) as bigint) as cluster_inertia,
  cast(sum(f.distance) over () as bigint) as inertia, sha256(array_to_string(c.x, ',')) as centroid_sha256
from final f join c{ROUNDS} c on f.cluster = c.cluster"""
    )


ORACLES["op13_orchard_clusters"] = _lloyd_sql()
