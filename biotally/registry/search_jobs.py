"""Registered jobs: seeded search, routing, alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from biotally.operators import align, search
from biotally.reference_tables import DEFAULT_ROUTE, NO_HIT_ROUTE, ROUTE_RULES, UNKNOWN_PAIR_SCORE, blosum62
from biotally.registry.core import job
from biotally.registry.oracle_views import windows_sql
from biotally.session import spread
from biotally.sources import tables as t

_L = "upper(regexp_replace(text, '[^A-Za-z]', '', 'g'))"


def _letters():
    return F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))


def _queries(spark, sf):
    return t.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), _letters().alias("seq"))


def _subjects(spark, sf):
    return t.dealt(t.table(spark, sf, "documents").select("doc_id", "text"), "doc_id").select(F.col("doc_id").alias("subject_id"), _letters().alias("seq"))


_SEARCH = f"""qs as (select item_id as query_id, {_L} as seq from benchmark), sj as (select doc_id as subject_id, {_L} as seq from documents),
{windows_sql('qw', 'qs', 'query_id', 16)},
{windows_sql('sw', 'sj', 'subject_id', 16)},
dg as (select query_id, subject_id, sw.i - qw.i as diagonal, count(*) as seeds from qw join sw using (w) group by 1, 2, 3),
bd as (select * from (select *, row_number() over (partition by query_id, subject_id order by seeds desc, diagonal) as r from dg) where r = 1),
ov as (select query_id, subject_id, diagonal, seeds, q.seq as q, substr(s.seq, cast(greatest(0, -diagonal) + diagonal + 1 as int), cast(least(length(q.seq) - greatest(0, -diagonal), length(s.seq) - greatest(0, -diagonal) - diagonal) as int)) as part,
  substr(q.seq, cast(greatest(0, -diagonal) + 1 as int), cast(least(length(q.seq) - greatest(0, -diagonal), length(s.seq) - greatest(0, -diagonal) - diagonal) as int)) as qpart
  from bd join qs q using (query_id) join sj s using (subject_id)),
hit as materialized (select query_id, subject_id, diagonal, seeds, cast(length(part) as int) as overlap, cast(length(part) - hamming(part, qpart) as int) as matches, (length(part) - hamming(part, qpart)) * 100.0::double / length(part) as identity,
  length(part) * 100.0::double / length(q) as coverage from ov),
rk as materialized (select *, cast(row_number() over (partition by query_id order by identity desc, matches desc, subject_id) as int) as rank from hit)"""


@job("seed_search", f"with {_SEARCH} select * from rk where rank <= 10")
def seed_search(spark, sf):
    return search.seed_search(_queries(spark, sf), _subjects(spark, sf))


# Titles and organisms given to the documents.
_TITLE = "case doc_id % 6 when 0 then 'capsid virus protein' when 1 then 'beta-lactamase' when 2 then 'plasmid replicon' else 'hypothetical protein' end"
_ORGANISM = "case doc_id % 5 when 0 then 'Escherichia' when 1 then 'herpes virus' else 'Bos taurus' end"
_TITLES = f"{_TITLE} as title, {_ORGANISM} as organism"


def _route(title: str, organism: str) -> str:
    cases = " ".join(f"when regexp_matches(lower({title if c == 'title' else organism}), '{p}') then '{r}'" for _, c, p, r in ROUTE_RULES)
    return f"case {cases} when {title} is not null then '{DEFAULT_ROUTE}' else '{NO_HIT_ROUTE}' end"


@job(
    "identify_sequences",
    f"""with {_SEARCH}, ti as (select doc_id as subject_id, {_TITLES} from documents)
    select qs.query_id, rk.subject_id, identity, coverage, {_route('title', 'organism')} as route from qs left join rk on rk.query_id = qs.query_id and rank = 1 left join ti on ti.subject_id = rk.subject_id""",
)
def identify_sequences(spark, sf):
    titles = t.table(spark, sf, "documents").select(F.col("doc_id").alias("subject_id"), F.expr(_TITLE).alias("title"), F.expr(_ORGANISM).alias("organism"))
    return search.identify_sequences(_queries(spark, sf), _subjects(spark, sf), titles)


@job("route_hit", f"with ti as (select {_TITLES} from documents) select title, organism, {_route('title', 'organism')} as route, count(*) as n from ti group by all")
def route_hit(spark, sf):
    titles = t.table(spark, sf, "documents").select(F.expr(_TITLE).alias("title"), F.expr(_ORGANISM).alias("organism"))
    kinds = titles.groupBy("title", "organism").agg(F.count("*").alias("n"))
    return kinds.select("title", "organism", search.route_hit(F.col("title"), F.col("organism")).alias("route"), "n")


def _pairs(spark, sf):
    """Each query against the whole text of its best subject."""
    best = search.seed_search(_queries(spark, sf), _subjects(spark, sf)).filter("rank = 1").select("query_id", "subject_id")
    q = _queries(spark, sf).select("query_id", F.col("seq").alias("a"))
    s = _subjects(spark, sf).select("subject_id", F.col("seq").alias("b"))
    rows = best.join(q, "query_id").join(s, "subject_id").select(F.col("query_id").alias("pair_id"), "a", "b")
    return spread(rows, "pair_id")


_LIST = "[" + ", ".join(str(blosum62().get((chr(65 + i), chr(65 + j)), UNKNOWN_PAIR_SCORE)) for i in range(26) for j in range(26)) + "]"


def _scores_sql(local: bool) -> str:
    """Scores of the pairs, a row of the grid of every pair a step; a gap run is a running maximum of (cell + 8 * column)."""
    cell = f"greatest(lag(v) over w + {_LIST}[(ascii(substr(a, i + 1, 1)) - 65) * 26 + c - 64], v - 8{', 0' if local else ''})"
    return f"""with recursive {_SEARCH}, pr as materialized (select rk.query_id as pair_id, qs.seq as a, sj.seq as b from rk join qs using (query_id) join sj using (subject_id) where rank = 1),
dp(pair_id, i, j, c, v, top) using key (pair_id, j) as (
  select pair_id, 0, cast(j as int), case when j > 0 then ascii(substr(b, j, 1)) end, cast({'0' if local else '-8 * j'} as int), 0 from (select pair_id, b, unnest(range(0, length(b) + 1)) as j from pr)
  union
  select pair_id, i + 1, j, c, v, greatest(top, max(v) over (partition by pair_id)) from (
    select pair_id, i, j, c, top, cast(max(t) over (partition by pair_id order by j) - 8 * j as int) as v from (
      select pair_id, i, j, c, top, case when j = 0 then {'0' if local else '-8 * (i + 1)'} else {cell} end + 8 * j as t from dp join pr using (pair_id) where i < length(a) window w as (partition by pair_id order by j))))
select pair_id, cast({'max(top)' if local else 'arg_max(v, j)'} as int) as score"""


def _checked(aligned):
    """The score, and what the aligned texts say: the score they add up to."""
    return aligned.withColumn("rescored", align.rescored(F.col("aligned_a"), F.col("aligned_b"), "protein"))


@job("align_pairs_local", f"{_scores_sql(True)}, cast(max(top) as int) as rescored from dp group by 1")
def align_pairs_local(spark, sf):
    return _checked(align.align_pairs(_pairs(spark, sf), "local", "protein")).select("pair_id", "score", "rescored")


@job("align_pairs_global", f"{_scores_sql(False)}, cast(arg_max(v, j) as int) as rescored, any_value(a) as letters_a, any_value(b) as letters_b from dp join pr using (pair_id) group by 1")
def align_pairs_global(spark, sf):
    """With the texts that are left without the gaps: those that were aligned."""
    gapless = [F.regexp_replace(f"aligned_{c}", "-", "").alias(f"letters_{c}") for c in "ab"]
    return _checked(align.align_pairs(_pairs(spark, sf), "global", "protein")).select("pair_id", "score", "rescored", *gapless)


@job("aligned_texts_local")
def aligned_texts_local(spark, sf):
    return align.align_pairs(_pairs(spark, sf), "local", "protein")


@job("aligned_texts_global")
def aligned_texts_global(spark, sf):
    return align.align_pairs(_pairs(spark, sf), "global", "protein")


@job(
    "alignment_stats",
    f"""with p as (select a.item_id as pair_id, rpad(a.x, cast(greatest(length(a.x), length(b.x)) as int), '-') as a, rpad(b.x, cast(greatest(length(a.x), length(b.x)) as int), '-') as b
      from (select item_id, {_L} as x from benchmark) a join (select item_id, {_L} as x from benchmark) b on b.item_id = a.item_id + 1),
    m as materialized (select pair_id, a, i, case when substr(a, i, 1) = '-' or substr(b, i, 1) = '-' then ' ' when substr(a, i, 1) = substr(b, i, 1) then '|'
      when {_LIST}[(ascii(substr(a, i, 1)) - 65) * 26 + ascii(substr(b, i, 1)) - 64] > 0 then ':' else '.' end as k from (select *, cast(unnest(range(1, length(a) + 1)) as int) as i from p))
    select pair_id, string_agg(k, '' order by i) as match_line, cast(count_if(k = '|') as int) as identical, cast(count_if(k in ('|', ':')) as int) as similar, cast(count_if(k = ' ') as int) as gaps,
    count_if(k = '|') * 100.0::double / count(*) as identity, count_if(k in ('|', ':')) * 100.0::double / count(*) as similarity from m group by 1""",
)
def alignment_stats(spark, sf):
    """Neighbouring benchmark texts laid side by side, the shorter one padded with gaps."""
    q = _queries(spark, sf)
    nxt = q.select((F.col("query_id") - 1).alias("query_id"), F.col("seq").alias("b"))
    p = q.join(nxt, "query_id").withColumn("n", F.greatest(F.length("seq"), F.length("b")))
    p = p.select(F.col("query_id").alias("pair_id"), F.expr("rpad(seq, n, '-')").alias("a"), F.expr("rpad(b, n, '-')").alias("b"))
    return p.select("pair_id", *[c.alias(n) for n, c in align.alignment_stats(F.col("a"), F.col("b")).items()])
