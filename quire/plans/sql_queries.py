
from __future__ import annotations

QUERIES: dict[str, str] = {}


def _add(**sql: str) -> None:
    QUERIES.update(sql)


# Sources and sinks ---------------------------------------------------------------------------------------------------
NATURAL = "{join}({map(regexp_extract_all(lower(url), '[0-9]+|[^0-9]+', 0); t; case when {like}(t, '^[0-9]') then concat('0', lpad(t, 20, '0')) else concat('1', t) end)}, ' ')"
_add(
    s2_rescan_keeps_prior_work="""
      select p.page_id, coalesce(s.n, 0) n_boxes, s.page_id is null is_new from (select distinct page_id from @pages) p
      left join (select page_id, count(*) n from boxes group by page_id) s on p.page_id = s.page_id""",
    s3_natural_sort=f"select page_id, cast(row_number() over (partition by folder order by natural_key, url, page_id) as bigint) place from (select page_id, url, regexp_extract(url, '^[a-z]+://([^/]*)', 1) folder, {NATURAL} natural_key from @pages) p",
    s9_safe_paths="""
      select page_id, {join}({keep({map(regexp_extract_all(path, '[^/]+', 0); s; s)}; s; s not in ('', '.', '..') and {strpos}(s, ':') = 0)}, '/') safe
      from (select page_id, concat('../', url, '/./', cast(page_id as {str})) path from @pages) p""",
    s11_template_export="""
      select page_id, {agg(concat('[', cast(page_id as {str}), ' #', cast(n as {str}), ']  ', speaker); /; n)} template, count(*) n_boxes
      from (select page_id, speaker, row_number() over (partition by page_id order by ord) n from lines) l group by page_id""",
    s13_import_reconcile="""
      select a.page_id, a.n, case when b.page_id is null then 'no such box' when a.english = '' then 'blank' else 'set' end outcome
      from (select page_id, ord + 1 n, case when ord % 5 = 0 then '' else upper(speaker) end english from lines union all select page_id, 999, 'x' from lines where ord = 0) a
      left join (select page_id, cast(row_number() over (partition by page_id order by ord) as bigint) n from lines) b on a.page_id = b.page_id and a.n = b.n""",
    s14_translations_export="""
      select page_id, {agg(concat(cast(ord as {str}), ':', speaker, ':', text); ~; ord)} regions from lines group by page_id""",
    s17_proofread_report="""
      select page_id, concat('## ', cast(page_id as {str}), ' (', cast(count(*) as {str}), ')') heading, {agg(concat('- ', speaker, ': ', trim(text)); ~; ord)} body,
      cast(sum(case when trim(coalesce(text, '')) = '' then 1 else 0 end) as bigint) todo from lines group by page_id""",
    s19_recent_first="""
      select user_id, event_type, cast(r as bigint) place from (
        select user_id, event_type, row_number() over (partition by user_id order by last desc, event_type) r from (
          select user_id, event_type, max(event_id) last from @events group by user_id, event_type) m) k where r <= 3""",
    s20_ledger_newest_400="select seq, uid, kind, coins from ledger order by seq desc limit 400",
    s21_user_receipt="select uid, seq, kind, coins from (select *, row_number() over (partition by uid order by seq desc) r from ledger) l where r <= least(100, greatest(1, 5))",
    s25_external_answers="""
      select l.page_id, l.ord, coalesce(a.answer, b.answer) answer from lines l
      left join (select page_id, ord, upper(speaker) answer from lines where ord % 2 = 0) a on a.page_id = l.page_id and a.ord = l.ord
      left join (select page_id, max(speaker) answer from lines where ord = 0 group by page_id) b on b.page_id = l.page_id""",
)

# Projections, filters, predicates --------------------------------------------------------------------------------------
_add(
    p1_active_boxes="select b.page_id, b.box_id from boxes b where not (b.box_id % 7 = 0) and not (b.kind = 'sfx' and b.page_id % 3 = 0)",
    p2_groups_present="""
      select page_id, {agg(family; ,; rank)} families from (select distinct b.page_id, f.family, f.rank from boxes b join families f on b.kind = f.kind) d group by page_id""",
    p3_family_with_default="""
      select b.box_id, coalesce(f.family, 'speech') family from (select box_id, case when box_id % 11 = 0 then 'odd' else kind end kind from boxes) b left join families f on b.kind = f.kind""",
    p4_only_ticked_kinds="""
      select box_id from boxes b where exists (select 1 from families f where f.kind = b.kind and f.family in ('speech', 'sound'))
      or not exists (select 1 from families f where f.family in ('speech', 'sound'))""",
    p5_drop_big_sfx="select box_id, kind, w, h from boxes where not (kind = 'sfx' and greatest(w, h) >= 0.3 * 480)",
    p7_empty_read_guard="""
      select page_id, ord from (select *, max(case when trim(t) <> '' then 1 else 0 end) over (partition by page_id) any_read from (
        select page_id, ord, case when ord % 3 = 0 or page_id % 4 = 0 then '' else coalesce(text, '') end t from lines) a) b where not (trim(t) = '' and any_read = 1)""",
    p11_retype_guard="select box_id, case when kind in ('sfx', 'freefloat') and score % 3 = 0 then case kind when 'sfx' then 'freefloat' else 'sfx' end else kind end kind from boxes",
    p12_label_acceptance="""
      select b.box_id, a.label from boxes b join (select box_id, case box_id % 4 when 0 then 'bubble' when 1 then 'sfx' when 2 then 'freefloat' else 'odd' end label, box_id % 5 <> 0 sure from boxes union all select -1, 'sfx', true) a
      on a.box_id = b.box_id join families f on f.kind = a.label join families g on g.kind = b.kind where a.sure and f.family = g.family""",
    p15_model_menu="""
      select m.step, m.model from (select distinct step, model from meter where step <> 'refund') m join (select distinct model from meter where boxes > 10) reachable on reachable.model = m.model
      where m.model <> 'm2' and not exists (select 1 from rates r where r.prefix = m.model and r.tin > 5)""",
    p17_proofread_rows="select page_id, ord, text from lines where trim(coalesce(text, '')) <> '' and speaker <> 'system'",
    p19_reads_on="""
      select page_id, ord, coalesce({like}(regexp_replace(trim(text), '["”]+$', ''), '(-|—|[.]{3}|…)$') or {like}(nxt, '^(-|—|[.]{3}|…)'), false) and not {like}(trim(text), '[!?]$') reads_on
      from (select *, lead(text) over (partition by page_id order by ord) nxt from (select page_id, ord, concat(trim(coalesce(text, '')), case ord % 4 when 0 then '...' when 1 then '!' else '' end) text from lines) z) l""",
    p20_username="""
      select name, case when length(name) < 3 then 'too short' when length(name) > 20 then 'too long' when not {like}(name, '^[a-z0-9_.-]+$') then 'characters' when not {like}(name, '[a-z0-9]$') then 'end'
        when {like}(name, '[_.-][_.-]') then 'doubled' when name in ('admin', 'root') then 'reserved' else 'ok' end verdict
      from (select distinct concat(event_type, case user_id % 6 when 0 then '__' when 1 then '_x' when 2 then '.' when 3 then ' a' when 4 then '_a_very_long_name_indeed' else '' end) name from @events union all select 'root' union all select 'ab') n""",
    p21_whole_numbers="select event_id, value = floor(value) is_whole, {like}(concat('price_', cast(event_id as {str})), '^price_[0-9]{2,}$') price_id from @events",
    p23_text_likeness="""
      select page_id, round(0.20 * least(1.0, n / 8.0) + 0.28 * (1 - least(1.0, sd_h / avg_h)) + 0.30 * (1 - least(1.0, sd_y / 300.0)) + 0.22 * (1 - least(1.0, sd_w / avg_w)), 6) likeness
      from (select page_id, count(*) n, stddev_pop(h) sd_h, avg(h) avg_h, stddev_pop(y) sd_y, stddev_pop(w) sd_w, avg(w) avg_w from boxes group by page_id) s""",
)

# Joins -------------------------------------------------------------------------------------------------------------------
_add(
    j1_best_panel="""
      select box_id, panel from (select b.box_id, p.panel, row_number() over (partition by b.box_id order by greatest(0, least(b.x+b.w, px+pw) - greatest(b.x, px)) * greatest(0, least(b.y+b.h, py+ph) - greatest(b.y, py)) desc, p.panel) r,
        2 * greatest(0, least(b.x+b.w, px+pw) - greatest(b.x, px)) * greatest(0, least(b.y+b.h, py+ph) - greatest(b.y, py)) >= b.w * b.h enough from boxes b join panels p on p.page_id = b.page_id) q where r = 1 and enough""",
    j3_label_transfer="""
      select box_id, coalesce(label, kind) kind from (select b.box_id, b.kind, m.label from boxes b left join (
        select a_id, b_kind label from (select *, row_number() over (partition by a_id order by inter * 1.0 / a_area desc, b_id) r from pairs) q where r = 1 and inter * 2 >= a_area) m on m.a_id = b.box_id) z""",
    j4_uncovered="select b.box_id from boxes b where not exists (select 1 from pairs p where p.a_id = b.box_id and p.b_kind = 'bubble' and 100 * p.inter >= 35 * p.a_area)",
    j6_any_direction_cover="select page_id, a_id, b_id from pairs where a_id < b_id and 100 * inter >= 80 * least(a_area, b_area)",
    j8_drop_parents="""
      select b.box_id from boxes b where not exists (select 1 from (select b_id parent, count(*) n from pairs where 100 * inter > 85 * a_area and (100 * a_area < 75 * b_area or (a_area < b_area and 100 * inter > 70 * a_area)) group by b_id) c
      where c.parent = b.box_id and c.n >= 2)""",
    j9_absorbed_by_similar="select b.box_id from boxes b where not exists (select 1 from pairs p where p.a_id = b.box_id and p.b_area > p.a_area and p.b_area <= 5 * p.a_area and 100 * p.inter >= 95 * p.a_area)",
    j10_crumbs="select b.box_id from boxes b where not exists (select 1 from pairs p where p.a_id = b.box_id and p.b_kind <> 'sfx' and p.b_area >= 3 * p.a_area and 100 * p.inter >= 85 * p.a_area)",
    j14_borrowed_shapes="""
      select box_id, case when exists (select 1 from pairs p where p.a_id = b.box_id and p.b_kind = 'bubble' and p.a_kind <> 'bubble' and 100 * p.inter >= 60 * (p.a_area + p.b_area - p.inter)) then 'reset' else 'own' end shape from boxes b""",
    j15_chapter_context="select page_id, {agg(coalesce(nullif(trim(text), ''), speaker); ~; ord)} context from lines where page_id % 10 <> 3 group by page_id",
    j16_reply_ids="""
      select coalesce(q.page_id, r.page_id) page_id, cast(count(case when r.ord is null then 1 end) as bigint) missing, cast(count(case when q.ord is null then 1 end) as bigint) extra
      from lines q full outer join (select page_id, case when ord = 1 then 77 else ord end ord from lines where ord <> 2) r on q.page_id = r.page_id and q.ord = r.ord group by coalesce(q.page_id, r.page_id)""",
    j17_first_answer="""
      select page_id, ord, answer from (select a.*, row_number() over (partition by page_id, ord order by place) r from (
        select page_id, ord % 4 ord, concat(speaker, cast(ord as {str})) answer, ord place from lines) a where exists (select 1 from lines l where l.page_id = a.page_id and l.ord = a.ord)) b where r = 1""",
    j18_longest_prefix="""
      select m.model, r.prefix, r.tin, r.tout from (select distinct model from meter union all select 'x9') m left join (
        select model, prefix, tin, tout, row_number() over (partition by model order by length(prefix) desc) k from (select distinct model from meter) d join rates on d.model like concat(prefix, '%')) r on r.model = m.model and k = 1""",
    j20_near_terms="""
      with w as (select distinct lower(tok) c from tokens where {like}(tok, '^[A-Za-z]+$')),
      v as (select c, case when i = 0 then c else concat({substr}(c, 1, cast(i as int) - 1), {substr}(c, cast(i as int) + 1)) end k from (select c, {each}({range}(0, cast(length(c) as int))) i from w) x)
      select distinct a.c word, b.c near from v a join v b on a.k = b.k and a.c <> b.c where greatest(length(a.c), length(b.c)) >= 4 and levenshtein(a.c, b.c) = 1""",
    j22_two_runs="""
      select a.page_id, a.ord, a.text ref, b.text cand from said a join (select page_id, ord, lower(text) text from said where ord % 3 <> 0) b on a.page_id = b.page_id and a.ord = b.ord""",
    j24_boxes_under="select page_id, box_id from boxes where x < 180 and x + w > 60 and y < 200 and y + h > 90",
    j25_pixel_owner="""
      select page_id, gx, gy, box_id from (select b.page_id, gx, gy, b.box_id, row_number() over (partition by b.page_id, gx, gy order by (2*gx - 2*b.x - b.w)*(2*gx - 2*b.x - b.w) + (2*gy - 2*b.y - b.h)*(2*gy - 2*b.y - b.h), b.box_id) r
        from boxes b join (select cast(60 + 90 * (i % 4) as bigint) gx, cast(60 + 90 * (i {div} 4) as bigint) gy from (select {each}({range}(0, 15)) i) s) g on gx >= b.x and gx < b.x + b.w and gy >= b.y and gy < b.y + b.h) q where r = 1""",
    j26_unknown_speakers="select speaker, count(*) n, count(distinct page_id) pages from said s where not exists (select 1 from families f where f.family = s.speaker) and speaker <> 'system' group by speaker",
    j27_grid_buckets="""
      select page_id, least(2, greatest(0, cx {div} 160)) col, least(2, greatest(0, cy {div} 160)) row_, count(*) n, min(x) x0, min(y) y0, max(x + w) x1, max(y + h) y1
      from (select *, x + w {div} 2 cx, y + h {div} 2 cy from boxes) b group by 1, 2, 3""",
    j28_neighbours_in_crop="select a.box_id, count(*) neighbours from boxes a join boxes b on a.page_id = b.page_id and b.x < a.x + a.w + 20 and b.x + b.w > a.x - 20 and b.y < a.y + a.h + 20 and b.y + b.h > a.y - 20 group by a.box_id",
    j30_reachable_and_priced="select distinct m.model, r.tin from meter m join rates r on r.prefix = m.model where m.boxes >= 20",
)

# Set operations ------------------------------------------------------------------------------------------------------------
_add(
    u1_union_of_passes="select page_id, box_id, min(pass) pass from (select page_id, box_id, 1 pass from boxes where score > 300 union all select page_id, box_id, 2 from boxes where kind <> 'sfx') u group by page_id, box_id",
    u3_symmetric_difference="select coalesce(a.kind, b.kind) kind, coalesce(a.page_id, b.page_id) page_id from (select distinct page_id, kind from boxes where score < 500) a full outer join (select distinct page_id, kind from boxes where score >= 500) b on a.page_id = b.page_id and a.kind = b.kind where a.kind is null or b.kind is null",
    u4_missing_and_extra="select page_id, 'missing' side from (select page_id from lines except select page_id from boxes) m union all select page_id, 'extra' from (select page_id from boxes except select page_id from lines) e",
    u5_distinct_cuts="select strip_id, cut from (select distinct strip_id, row_no {div} 100 cut from flags) c",
    u6_menu_arithmetic="(select model from meter where step = 'click' intersect select model from meter where step = 'view') except select prefix from rates",
)

# Aggregations --------------------------------------------------------------------------------------------------------------
_add(
    a6_untranslated="select page_id, count(*) n from lines where trim(coalesce(text, '')) <> '' and speaker = 'user' group by page_id",
    a9_name_table="select a.tok source, lower(b.tok) target, count(*) n from (select doc_id, tok from tokens where length(tok) >= 9) a join (select doc_id, tok from tokens where length(tok) >= 9) b on a.doc_id = b.doc_id and a.tok < b.tok group by a.tok, lower(b.tok) having count(*) >= 2",
    a12_exact_matches="select count(*) n, cast(sum(case when lower(trim(a.text)) = lower(trim(b.text)) then 1 else 0 end) as bigint) exact from said a join (select page_id, ord, case when ord % 2 = 0 then lower(text) else concat(text, 'x') end text from said) b on a.page_id = b.page_id and a.ord = b.ord",
    a13_cost_of_a_run="select step, model, cast(ceil(sum(predicted * coalesce(r.tin, 3) + metered * coalesce(r.tout, 15)) / 1000.0) as bigint) coins from meter m left join rates r on r.prefix = m.model group by step, model",
    a14_rounding="select event_id, cast(ceil(value) as bigint) coins, cast(ceil(1.25 * ceil(value)) as bigint) hold from @events",
    a15_drift_report="""
      with newest as (select *, row_number() over (partition by step, model order by seq desc) r from meter where boxes >= 20)
      select step, model, count(*) runs, cast(sum(metered) as bigint) metered, cast(sum(predicted) as bigint) predicted, cast(least(250, greatest(20, (100 * sum(metered)) {div} sum(predicted))) as bigint) percent from newest where r <= 8 group by step, model""",
    a17_accuracy="select step, model, count(*) runs, cast(sum(boxes) as bigint) boxes, cast(sum(predicted) as bigint) charged, cast(sum(metered) as bigint) really from meter group by step, model",
    a21_pictures="select page_id, count(*) boxes, cast(case when count(*) < 5 then 1 when count(*) < 9 then 4 when count(*) < 12 then 9 else count(*) end as bigint) pictures from boxes group by page_id",
    a23_balance="select uid, cast(sum(case kind when 'credit' then coins when 'spend' then -coins else 0 end) as bigint) balance from ledger group by uid",
    a24_one_per_price="select model, predicted from (select model, predicted, row_number() over (partition by predicted order by seq) r from meter) m where r = 1 or model = 'm3'",
    a26_median_cap="""
      select b.box_id, least(b.h, m.cap) size from boxes b join (select page_id, greatest(20, cast(floor(1.1 * median(h)) as bigint)) cap from boxes where kind <> 'sfx' group by page_id having count(*) >= 4) m on m.page_id = b.page_id where b.kind <> 'sfx'""",
    a29_box_and_character_counts="select page_id, count(*) n, cast(sum(length(text)) as bigint) characters from lines group by page_id",
)

# Windows and sequences --------------------------------------------------------------------------------------------------------
_add(
    w1_reading_rank="select page_id, ord, cast(row_number() over (partition by page_id order by ord) as bigint) rank_ from lines",
    w2_order_compaction="select page_id, box_id, cast(row_number() over (partition by page_id order by case when score % 5 = 0 then null else score end nulls last, y, box_id) - 1 as bigint) ord from boxes",
    w3_gutters="""
      select strip_id, min(row_no) first_row, max(row_no) last_row, count(*) n from (
        select strip_id, row_no, flat, row_number() over (partition by strip_id order by row_no) - row_number() over (partition by strip_id, flat order by row_no) island from flags) f where flat group by strip_id, island having count(*) >= 3""",
    w4_interval_gaps="""
      select page_id, x - reach width, (x + reach) {div} 2 middle from (select page_id, x, max(x + w) over (partition by page_id order by x, box_id rows between unbounded preceding and 1 preceding) reach from boxes) b where x - reach > 4""",
    w7_prefix_split="""
      select page_id, box_id, cast(floor(4.0 * (upto - h) / total) as bigint) part from (select page_id, box_id, h, sum(h) over (partition by page_id order by box_id) upto, sum(h) over (partition by page_id) total from boxes) b""",
    w8_range_min_max="select strip_id, row_no, min((row_no*13)%97) over (partition by strip_id order by row_no rows between 3 preceding and 3 following) low, max((row_no*13)%97) over (partition by strip_id order by row_no rows between 3 preceding and 3 following) high from flags",
    w9_last_lines="select page_id, ord, speaker from (select *, row_number() over (partition by page_id order by ord desc) r from said) s where r <= 6",
    w10_first_rendering="select term, doc_id, tok from (select lower(tok) term, doc_id, tok, row_number() over (partition by lower(tok) order by doc_id, tok) r from tokens) t where r = 1",
    w11_conflict_with_earlier="""
      select term, doc_id, tok, before_ from (select lower(tok) term, doc_id, tok, first_value(tok) over (partition by lower(tok) order by doc_id, tok) before_, min(doc_id) over (partition by lower(tok)) first_doc from (select distinct doc_id, tok from tokens) d) t where tok <> before_ and doc_id > first_doc""",
    w12_running_balance="select uid, seq, cast(sum(case kind when 'credit' then coins when 'spend' then -coins else 0 end) over (partition by uid order by seq) as bigint) balance from ledger",
)

# Sorts, limits, top-k -------------------------------------------------------------------------------------------------------------
_add(
    o1_natural_order=f"select page_id, {NATURAL} natural_key from @pages",
    o2_keep_newest="select user_id, event_id from (select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) r from @events) e where r <= 3",
    o3_largest_first="select page_id, box_id, cast(row_number() over (partition by page_id order by w * h desc, box_id) as bigint) place from boxes",
    o4_menu_order="select step, model, cast(row_number() over (partition by step order by coalesce(tin, 1000000), model) as bigint) place from (select distinct step, model from meter) m left join rates r on r.prefix = m.model",
    o5_newest_receipt="select seq, uid, coins from ledger order by seq desc limit 100",
    o6_first_references="select low, {agg(cast(doc_id as {str}); ,; doc_id)} refs from (select low, doc_id, row_number() over (partition by low order by doc_id) r from (select distinct lower(tok) low, doc_id from tokens) d) e where r <= 4 group by low",
    o7_permutation="select page_id, count(distinct o) = count(*) and min(o) = 0 and max(o) = count(*) - 1 is_permutation from (select page_id, case when page_id % 3 = 0 then ord else ord * 2 end o from lines) l group by page_id",
    o8_queue_reorder="select user_id, event_id, cast(row_number() over (partition by user_id order by case when place = 2 then 1 when place = 1 then 2 else place end) as bigint) place from (select user_id, event_id, row_number() over (partition by user_id order by event_id) place from @events where event_type <> 'refund') q",
    o9_version_order="""
      select v, a, b, c, a > 5 or (a = 5 and (b > 3 or (b = 3 and c > 1))) newer from (select v, coalesce(try_cast(regexp_extract(v, '^([0-9]+)', 1) as bigint), -1) a, coalesce(try_cast(regexp_extract(v, '^[0-9]+[.]([0-9]+)', 1) as bigint), 0) b, coalesce(try_cast(regexp_extract(v, '^[0-9]+[.][0-9]+[.]([0-9]+)', 1) as bigint), 0) c
      from (select distinct concat(cast(event_id % 12 as {str}), case when event_id % 2 = 0 then concat('.', cast(event_id % 7 as {str})) else '' end, case when event_id % 4 = 0 then concat('.', cast(event_id % 30 as {str})) else '' end) v from @events union all select 'junk') x) y""",
)

# Graph, merges, entities --------------------------------------------------------------------------------------------------------
_add(
    m8_grant_once="""
      select uid, mail, seq from (select uid, mail, seq, row_number() over (partition by mail order by seq) m, row_number() over (partition by uid order by seq) u from (select user_id uid, user_id % 50 mail, event_id seq from @events where event_type = 'signup') s) r where m = 1 and u = 1""",
    m9_first_claim="select key_, min_by(uid, seq) uid from (select replace(replace(concat('n', cast(event_id % 97 as {str})), '0', 'o'), '1', 'l') key_, user_id uid, event_id seq from @events where event_type = 'signup') c group by key_",
    m10_hold_and_settle="select step, model, seq, cast(least(metered, ceil(1.25 * predicted)) as bigint) kept, cast(ceil(1.25 * predicted) as bigint) - cast(least(metered, ceil(1.25 * predicted)) as bigint) returned from meter",
    m12_pack_price="select uid, seq, case when coins >= 150 then 'large' when coins >= 50 then 'middle' else 'small' end pack from ledger where kind = 'credit'",
    m13_split_page="""
      select b.page_id, b.box_id, c.part, greatest(0, b.y - c.y0) y, least(b.y + b.h, c.y1) - greatest(b.y, c.y0) h from boxes b join (select {each}({range}(0, 2)) part) z on true
      join (select 0 part, 0 y0, 150 y1 union all select 1, 150, 300 union all select 2, 300, 480) c on c.part = z.part where b.y + b.h / 2.0 >= c.y0 and b.y + b.h / 2.0 < c.y1 and least(b.y + b.h, c.y1) - greatest(b.y, c.y0) >= 2""",
    m14_restitch="""
      select t.strip_id, t.row_no, c.cut, cast(least(t.y1, c.y1) - greatest(t.y0, c.y0) as bigint) rows_ from (select strip_id, row_no, sum(h) over (partition by strip_id order by row_no) - h y0, sum(h) over (partition by strip_id order by row_no) y1 from (select strip_id, row_no, 100 + row_no % 50 h from flags) f) t
      join (select cast(cut as bigint) cut, cut * 400 y0, cut * 400 + 400 y1 from (select {each}({range}(0, 9)) cut) s) c on true where least(t.y1, c.y1) > greatest(t.y0, c.y0)""",
)

# Scalar functions --------------------------------------------------------------------------------------------------------------------
_add(
    f12_geometry="select page_id, a_id, b_id, round(cast(inter as {dbl}) / (a_area + b_area - inter), 6) iou, round(cast(inter as {dbl}) / a_area, 6) share, least(ax, bx) ux, least(ay, by_) uy, greatest(ax + aw, bx + bw) - least(ax, bx) uw from pairs where a_id < b_id",
    f17_fixed_prefix="select event_id, {substr}(props, 1, greatest(0, {strpos}(props, ':') - 1)) fixed from @events",
    f18_payload="select page_id, concat('{\"page\":', cast(page_id as {str}), ',\"regions\":[', {agg(cast(ord as {str}); ,; ord)}, ']}') payload from lines group by page_id",
    f22_ages="select event_id, {epoch(ts)} - first age from @events cross join (select min({epoch(ts)}) first from @events) f",
)

# Stateful and streaming shapes, in batch form ------------------------------------------------------------------------------------------
_add(
    t11_tumbling_counts="select event_type, {epoch(ts)} {div} 86400 day_, count(*) n, round(sum(value), 4) total from @events group by 1, 2",
)
_add(
)
_add(
    g13_run_angle="""
      select page_id, count(*) marks, round(degrees(0.5 * atan2(2 * covar_pop(cx, cy), var_pop(cx) - var_pop(cy))), 4) angle from (select page_id, x + w * cast(0.5 as {dbl}) cx, y + h * cast(0.5 as {dbl}) cy from boxes where kind = 'sfx') b group by page_id having count(*) >= 3""",
)
