"""SQL equivalents where SQL can express the operator on whole tables."""

_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"

_NEAR = f"""with recursive t as (select 'chunk' kind, row_id k, {_WORDS.format('content')} w from chunks union all select 'abstract', canon_id, {_WORDS.format('abstract')} from canonical_docs),
 c as (select kind, k, n, word, count(*) c from (select kind, k, len(w) n, unnest(w) word from t where len(w) >= 40) group by all),
 s as (select a.kind, a.k key_a, b.k key_b, a.n na, b.n nb, sum(least(a.c, b.c)) m from c a join c b on a.kind = b.kind and a.word = b.word and a.k < b.k and least(a.n, b.n) >= 0.7 * greatest(a.n, b.n) group by all),
 found as (select kind, key_a, key_b from s where m >= 0.7 * (na + nb - m))"""
_SOURCE = "nullif(regexp_replace(lower(trim({})), '[- ]+', '_', 'g'), '')"

ORACLES: dict[str, str] = {
    "p5_found": _NEAR + " select kind, key_a, key_b from found",
    "p5_classes": _NEAR + """, ends as (select kind, key_a a, key_b b from found union all select kind, key_b, key_a from found),
 reach as (select distinct kind, a, a b from ends union select r.kind, r.a, e.b from reach r join ends e on e.kind = r.kind and e.a = r.b),
 n as (select kind, a, count(*) links from ends group by all)
 select kind, a "key", min(reach.b) class_id, any_value(links) links from reach join n using (kind, a) group by kind, a""",
    "p7_targets": f"""with t as (select mix_id, {_SOURCE.format('source')} source, sum(coalesce(target_weight, 0)) w, greatest(coalesce(max(max_repeats), 1), 1) repeats from mix_targets where mix_id is not null group by 1, 2 having sum(coalesce(target_weight, 0)) > 0),
 d as (select {_SOURCE.format('source')} source, count(*) docs from documents where coalesce(text, '') <> '' group by 1),
 p as (select mix_id, t.source, repeats, coalesce(docs, 0) docs, case when docs is not null then w else 0 end w from t left join d on t.source = d.source where t.source is not null)
 select mix_id, source, round(w / sum(w) over (partition by mix_id), 6) target_share, repeats, docs, true on_target, true within_repeats from p""",
}
