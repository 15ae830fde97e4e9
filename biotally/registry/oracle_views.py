"""The views of biotally.sources.tables written as DuckDB SQL, for the oracle texts."""

_DNA = "translate(upper(regexp_replace(text,'[^A-Za-z]','','g')),'BDEFHIJKLMNOPQRSUVWXYZ','ACGTACGTACGTACGTACGTAC')"
_HOURS = "(epoch_us(ts) - epoch_us(timestamp '2024-01-01 00:00:00')) / 3600000000.0::double"

VIEWS = {
    "isolates": f"""select doc_id as isolate_id, lang as location, source, lang || '-' || cast(doc_id // 28 as varchar) as cluster,
        doc_id // 28 as batch, cast(date '2024-01-01' + cast(doc_id % 365 as int) as date) as collected, x as seq
        from (select doc_id, lang, source, {_DNA} as x from documents) t where x <> ''""",
    "proteins": """select doc_id as protein_id, lang as species, x as seq from (select doc_id, lang,
        regexp_replace(upper(regexp_replace(text,'[^A-Za-z]','','g')),'[BJOUXZ]','','g') as x from documents) t where x <> ''""",
    "benchmark_dna": f"select item_id as seq_id, {_DNA} as seq from benchmark",
    "compounds": """select p_partkey as drug_id, p_name as name, lower(split_part(p_name, ' ', 1)) as inn, p_type as pharm_group,
        case p_type when 'ECONOMY' then 'DNA gyrase inhibitor' when 'SMALL' then '30S subunit binder'
        when 'MEDIUM' then 'transpeptidase (PBP) inhibitor' when 'PROMO' then 'RdRp polymerase inhibitor'
        when 'STANDARD' then 'protease (3CL) inhibitor' end as mechanism,
        case p_partkey % 3 when 0 then 'antibacterial' when 1 then 'antiviral' else 'unknown' end as activity,
        cast(86 + (p_partkey * 37) % 1000 as double) as mw, cast((p_partkey * 13) % 110 as double) / 10 - 3 as logp,
        cast(p_size % 8 as int) as hbd, cast((p_partkey * 7) % 14 as int) as hba, cast((p_partkey * 5) % 16 as int) as rotatable_bonds,
        cast((p_partkey % 7) - 3 as int) as charge, cast((p_partkey * 29) % 101 as double) / 100 as hydrophobicity,
        cast(2 as double) + cast((p_partkey * 11) % 140 as double) / 10 as radius, p_partkey % 2 = 0 as registered from part""",
    "od_readings": """select event_id, user_id % 10 as plate,
        case event_type when 'view' then 'neg' when 'purchase' then 'pos' else 'sample' end as control,
        case when event_type = 'purchase' then value / 100.0::double + 0.3::double else value / 100.0::double end as od from events""",
    "doses": f"select event_id, user_id as subject, {_HOURS} as t, value as dose from events where event_type = 'purchase'",
    "samples": f"select event_id, user_id as subject, {_HOURS} as t, value as conc from events where event_type = 'click'",
    "patients": """select o_orderkey as patient_id, cast(o_custkey % 39 as int) as rate_id, cast(5 + o_orderkey % 600 as double) as weight,
        case o_orderstatus when 'P' then 'neonate' when 'O' then 'young' else 'adult' end as age_group,
        case when o_orderkey % 5 = 0 then null else cast(10 * (1 + o_orderkey % 10) as double) end as concentration,
        case when o_orderkey % 7 = 0 then null else cast(1 + o_orderkey % 9 as double) / 4 end as price from orders""",
    "tox_predictions": """select doc_id as mol_id, e.endpoint as endpoint, l.label as label,
        case when l.label = 'toxic' then cast((doc_id * 7 + e.endpoint * 13) % 100 as double) / 100
        else cast(100 - (doc_id * 7 + e.endpoint * 13) % 100 as double) / 100 end as score
        from labels cross join (values (1),(2),(3),(4),(5)) as e(endpoint) cross join (values ('toxic'),('safe')) as l(label)
        where not (doc_id % 11 = 0 and e.endpoint = 5)""",
    "residue_probs": """select vec_id // 25 as protein_id, cast(vec_id % 25 + 1 as int) as pos, substr('ACDEFGHIKLMNPQRSTVWY', cast(i as int), 1) as residue,
        exp(cast(embedding[i] as double)) / sum(exp(cast(embedding[i] as double))) over (partition by vec_id) as prob
        from (select vec_id, embedding, unnest(range(1,21)) as i from embeddings)""",
    "wild_types": """select vec_id // 25 as protein_id, cast(vec_id % 25 + 1 as int) as pos,
        substr('ACDEFGHIKLMNPQRSTVWY', cast((vec_id * 7) % 20 + 1 as int), 1) as residue from embeddings""",
    "fingerprints": """select mol_id, label, cast(i as int) as bit from
        (select vec_id as mol_id, label, embedding, unnest(range(1,65)) as i from embeddings) where embedding[i] > 0""",
}


def windows_sql(name: str, view: str, key: str, k: int, partial: bool = False, seq: str = "seq", extra: str = "") -> str:
    """CTEs giving each window of k letters as (key, i, w), 1-based.

    Goes through overlapping tiles of 512 letters, because substr on a long text walks it from the start.
    ``partial`` keeps the shorter windows at the end; ``extra`` names further columns of the view to carry.
    """
    more = f", {extra}" if extra else ""
    last = "n" if partial else f"n - {k - 1}"
    return (
        f"{name}_tiles as materialized (select {key}{more}, b, n, substr({seq}, cast(b * 512 + 1 as int), {512 + k - 1}) as tile from "
        f"(select {key}{more}, {seq}, length({seq}) as n, unnest(range(0, (length({seq}) + 511) // 512)) as b from {view})),\n"
        f"{name} as materialized (select {key}{more}, cast(b * 512 + i as int) as i, substr(tile, cast(i as int), {k}) as w from "
        f"(select {key}{more}, b, tile, unnest(range(1, least(512, {last} - b * 512) + 1)) as i from {name}_tiles))"
    )


def folding_sql(src: str, name: str) -> str:
    """Hairpin and self dimer of each distinct word of ``src`` (w, n)."""
    return f"""{name}_ij as (select w, i, unnest(range(i + 4, n + 1)) as j from (select w, n, unnest(range(1, n - 3)) as i from {src})),
{name}_st as (select w, i, j, l, substr(w, i + l, 1) = translate(substr(w, j - l, 1), 'ACGT', 'TGCA') as ok from (select w, i, j, unnest(range(0, (j - i + 1) // 2)) as l from {name}_ij)),
{name}_hp as materialized (select w, case when max(r) >= 3 then -1.5::double * max(r) else 0.0::double end as hairpin from (select w, i, j, coalesce(min(case when not ok then l end), max(l) + 1) as r from {name}_st group by 1, 2, 3) group by 1),
{name}_sd as materialized (select w, case when max(pairs) >= 4 then -max(pairs)::double else 0.0::double end as self_dimer from (select w, o, count_if(substr(w, i, 1) = translate(substr(w, n - (i - o) + 1, 1), 'ACGT', 'TGCA')) as pairs from
  (select w, n, o, unnest(range(greatest(1, 1 + o), least(n, n + o) + 1)) as i from (select w, n, unnest(range(3 - n, n - 3)) as o from {src})) group by 1, 2) group by 1)"""
