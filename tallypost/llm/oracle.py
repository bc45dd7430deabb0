"""What operator queries return, as SQL for DuckDB, where SQL can say it."""

_COLLOCATIONS = r"""
with pieces as (
    select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
    from documents where text is not null
), runs as (
    select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as ws from pieces
), g1 as (
    select lang, w1, count(*)::hugeint as f from (select lang, unnest(ws) as w1 from runs) group by all
), g2 as (
    select lang, ws[i] as w1, ws[i + 1] as w2, count(*)::hugeint as f
    from (select lang, ws, unnest(range(1, len(ws))) as i from runs) group by all
), g3 as (
    select lang, ws[i] as w1, ws[i + 1] as w2, ws[i + 2] as w3, count(*)::hugeint as f
    from (select lang, ws, unnest(range(1, len(ws) - 1)) as i from runs) group by all having count(*) >= 10
), totals as (
    select lang, sum(f)::bigint as n from g1 group by all
), longer as (
    select lang, w1, w2, max(f) as longest from (
        select lang, w1, w2, f from g3 union all select lang, w2, w3, f from g3
    ) group by all
), two as (
    select g2.lang, g2.w1 || ' ' || g2.w2 as phrase, g2.f as a, x.f as l, y.f as r,
        1000000 * g2.f * g2.f // (x.f * y.f) as score
    from g2 join g1 x on x.lang = g2.lang and x.w1 = g2.w1 join g1 y on y.lang = g2.lang and y.w1 = g2.w2
    left join longer on longer.lang = g2.lang and longer.w1 = g2.w1 and longer.w2 = g2.w2
    where g2.f >= 10 and not coalesce(100 * longest >= 50 * g2.f, false)
), cuts as (
    select g3.lang, g3.w1 || ' ' || g3.w2 || ' ' || g3.w3 as phrase, g3.f as a,
        a1.f as l1, b1.f as r1, 1000000 * g3.f * g3.f // (a1.f * b1.f) as s1,
        a2.f as l2, b2.f as r2, 1000000 * g3.f * g3.f // (a2.f * b2.f) as s2
    from g3 join g1 a1 on a1.lang = g3.lang and a1.w1 = g3.w1
    join g2 b1 on b1.lang = g3.lang and b1.w1 = g3.w2 and b1.w2 = g3.w3
    join g2 a2 on a2.lang = g3.lang and a2.w1 = g3.w1 and a2.w2 = g3.w2
    join g1 b2 on b2.lang = g3.lang and b2.w1 = g3.w3
), scored as (
    select * from two
    union all
    select lang, phrase, a, case when s2 < s1 then l2 else l1 end, case when s2 < s1 then r2 else r1 end,
        least(s1, s2)
    from cuts
), ranked as (
    select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from scored
)
select lang, rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score
from ranked join totals using (lang) where rank <= 2000
"""

_NEGATIVES = """
with v as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda x: floor(256 * x::double)) as e
    from embeddings
    where vec_id is not null and label is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
    select a.vec_id as anchor_id, a.label as anchor_label, b.vec_id, b.label, list_dot_product(a.e, b.e)::bigint as score
    from v a join v b on len(a.e) = len(b.e) where a.vec_id % 100 = 0
), positives as (
    select anchor_id, vec_id as positive_id, score as positive_score from scored
    where label = anchor_label and vec_id <> anchor_id
    qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, vec_id)::int as rank,
    vec_id as negative_id, positive_score, score as negative_score
from positives join scored using (anchor_id)
where label <> anchor_label and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify rank <= 10
"""

SQL: dict[str, str] = {"op12_hard_negatives": _NEGATIVES, "op13_collocations": _COLLOCATIONS}
