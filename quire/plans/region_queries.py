"""Queries of the rules on regions, names, settings and costs: each calls its operator; the SQL beside it states the rule on its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as kernels
from quire.operators import cost, evaluate, greedy, ledger, names, pages, regions, settings
from quire.plans.dialect import view
from quire.plans.grouped_queries import query
from quire.sources import formats


def _regions(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "regions")


# What SQL needs of the rules, in RE2: letters and numbers, Japanese classes, and a run of seven.
WRITES = "regexp_matches(coalesce({0}, ''), '[\\p{{Lu}}\\p{{Ll}}\\p{{Lt}}\\p{{Lo}}\\p{{N}}]')"
SYMBOLS = f"(trim(coalesce({{0}}, '')) <> '' and not {WRITES})"
PROTECTED = "(own_text or locked or trim(coalesce(dst, '')) <> '')"


@query("p6_symbol_only", oracle=f"select page_id, id from regions where not {SYMBOLS.format('src')} or {PROTECTED}")
def p6(s: SparkSession, d: str) -> DataFrame:
    return regions.without_symbols(_regions(s, d)).select("page_id", "id")


@query("p8_garbage_gate", oracle=f"""
  select page_id, id, case when v = '' then 'empty' when {SYMBOLS.format('v')} then 'punctuation only'
    when len(list_filter(range(1, length(v) - 5), lambda i: substr(v, i, 7) = repeat(substr(v, i, 1), 7))) > 0 then 'repeated character run'
    when ink > 0 and length(v) > 30 and length(v) * 12 > ink then 'implausible length' end reason
  from (select page_id, id, ink, regexp_replace(concat(coalesce(src, ''), case when m % 3 = 0 then repeat(coalesce(dst, ''), 4) else '' end), '\\s+', '', 'g') v from regions) r""")
def p8(s: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.coalesce("src", F.lit("")), F.when(F.col("m") % 3 == 0, F.repeat(F.coalesce("dst", F.lit("")), 4)).otherwise(""))
    return _regions(s, d).select("page_id", "id", regions.garbage(text, F.col("ink")).alias("reason"))


@query("p9_sound_or_speech", oracle="""
  select page_id, id, case when own_text then kind when in_balloon then 'bubble'
    when b = '' or (length(b) <= 12 and not regexp_matches(b, '[一-鿿㐀-䶿]') and len(list_filter(string_split('をにはがでとものねよかなわぞぜだすまし', ''), lambda c: contains(b, c))) = 0) then 'sfx' else 'freefloat' end kind
  from (select *, translate(coalesce(src, ''), concat(' ', chr(9), chr(10), chr(13), '。、．，!?！？…‥・「」『』（）()〜~-'), '') b from regions) r""")
def p9(s: SparkSession, d: str) -> DataFrame:
    return regions.relabelled(_regions(s, d)).select("page_id", "id", "kind")


TALLY = """
  with a as (select * from regions where not hidden), c as (
    select page_id, count(*) n, count(*) filter (where not own_text) regions_, count(*) filter (where coalesce(src, '') <> '') ocr, count(*) filter (where coalesce(dst, '') <> '') translated,
      count(*) filter (where typeset) typeset, count(*) filter (where proofread) proofread from a group by page_id)
  select p.page_id, coalesce(regions_, 0) regions, coalesce(ocr, 0) ocr, coalesce(translated, 0) translated, coalesce(typeset, 0) typeset, coalesce(proofread, 0) proofread,
    case when n is null and detected then 'done' when n is null then 'pending' when n = translated then 'translated' when ocr > 0 then 'ocr' else 'detected' end status
  from page_states p left join c on c.page_id = p.page_id"""


@query("a1_page_tally", oracle=TALLY)
def a1(s: SparkSession, d: str) -> DataFrame:
    return regions.tally(_regions(s, d), view(s, d, "page_states"))


@query("p10_page_status", oracle=f"select page_id, status from ({TALLY}) t")
def p10(s: SparkSession, d: str) -> DataFrame:
    return a1(s, d).select("page_id", "status")


@query("p13_angles", oracle="""
  select r.page_id, r.id, case when kind <> 'sfx' or by_hand or (sfx_len > 0 and sfx_wid > 0) or k.a is null or abs(k.a - angle) <= 0.05 then angle else k.a end angle
  from regions r left join (select page_id, id, cast((m * 3) % 30 as double) a from regions where m % 4 > 0) k on k.page_id = r.page_id and k.id = r.id""")
def p13(s: SparkSession, d: str) -> DataFrame:
    read = _regions(s, d).where("m % 4 > 0").select("page_id", "id", ((F.col("m") * 3) % 30).cast("double").alias("read_angle"))
    return regions.with_angles(_regions(s, d), read).select("page_id", "id", "angle")


LOUD = "coalesce(list_max(list_transform(regexp_extract_all(coalesce({0}, ''), '[!?！？]{{2,}}'), lambda x: length(x))), 0)"


@query("p16_line_quality_flags", oracle=f"""
  select page_id, id, case when regexp_matches(t, '[A-Za-z][*]|[*][A-Za-z]|[A-Za-z][#@$%&][#@$%&!*]+') and not regexp_matches(f, '[*＊〇○●×✕✖#＃$＄@＠%％]') then 'masked'
    when {LOUD.format('src')} >= 2 and {LOUD.format('dst')} < {LOUD.format('src')} then 'quieter'
    when f <> '' and t <> '' and (right(f, 1) in ('…', '‥', '—', '―', '－') or right(f, 3) in ('...', '．．．')) and not right(t, 1) in ('.', '!', '?', '…', '‥', '—', '–', '-', '"', '''', '”', '’', '」', '』', '）', ')', '】', '』', '～', '~') then 'stops short'
    when holds >= 4 and length(t) > 1.25 * holds then 'too long' end note
  from (select *, trim(coalesce(src, '')) f, trim(coalesce(dst, '')) t, floor(cast(w * h as double) * 0.55 / (1.05 * 144)) holds from regions) r""")
def p16(s: SparkSession, d: str) -> DataFrame:
    return _regions(s, d).select("page_id", "id", regions.line_note(F.col("src"), F.col("dst"), regions.room(F.col("w"), F.col("h"))).alias("note"))


@query("p18_generic_speaker", oracle="select page_id, id, m % 6 <> 3 generic from regions")
def p18(s: SparkSession, d: str) -> DataFrame:
    """A guard, a petitioner's father, nobody, Leonora, a crowd and a number: of these one has a name."""
    m = F.col("m") % 6
    speaker = F.when(m == 0, "Guard A").when(m == 1, "Petitioner's Father").when(m == 3, "Leonora").when(m == 4, "The crowd!").when(m == 5, "42")
    return _regions(s, d).select("page_id", "id", names.generic(speaker).alias("generic"))


@query("p22_retired_notes", oracle="""
  select page_id, id, nullif(trim(concat(case when m % 3 = 0 then 'keep me. ' else '' end, case when m % 5 = 0 then 'look at this' else '' end)), '') note from regions""")
def p22(s: SparkSession, d: str) -> DataFrame:
    m = F.col("m")
    note = F.concat(F.when(m % 2 == 0, "old note. ").otherwise(""), F.when(m % 3 == 0, "keep me. keep me. ").otherwise(""), F.when(m % 5 == 0, "look at this").otherwise(""), F.when(m % 15 == 0, " keep me.").otherwise(""))
    return _regions(s, d).select("page_id", "id", regions.without_notes(note, ["old note. "], ["keep me."]).alias("note"))


READS = """coalesce({a} <> '' and {b} <> '' and not right({a}, 1) in ('。', '．', '！', '？', '!', '?') and (contains('—–―─━〜～…‥', right({a}, 1)) or contains('—–―─━〜～…‥', left({b}, 1))), false)"""
CLOSED = "rtrim(trim(coalesce(src, '')), '」』）)】〕》”\"''')"


@query("g11_section_links", oracle=f"""
  with g as (select page_id, box_group, id, {CLOSED} a, ltrim(trim(coalesce(lead(src) over (partition by page_id, box_group order by ord, id), '')), '「『（(【〔《“"''') b, lead(id) over (partition by page_id, box_group order by ord, id) nxt from regions where box_group > 0),
  v as (select page_id, box_group, min(id) first, count(*) n, bool_and(nxt is null or {READS.format(a='a', b='b')}) joined from g group by page_id, box_group having count(*) >= 2),
  k as (select *, row_number() over (partition by page_id, joined order by first) + (select max(link) from regions r where r.page_id = v.page_id) new from v)
  select r.page_id, r.id, case when k.page_id is null then r.link when joined then new else 0 end link, case when k.page_id is null then r.link_kind when joined then 'sentence' else '' end link_kind
  from regions r left join k on k.page_id = r.page_id and k.box_group = r.box_group""")
def g11(s: SparkSession, d: str) -> DataFrame:
    return regions.linked(_regions(s, d)).select("page_id", "id", "link", "link_kind")


DOTTED = "regexp_matches(rtrim(coalesce({0}, '')), '([.]{{2,}}|[…‥]+|・{{2,}}|。{{2,}})$')"


@query("g12_linked_tails", oracle=f"""
  with l as (select *, trim(coalesce(dst, '')) t, case when link > 0 and link_kind <> 'balloon' then link end k from regions),
  n as (select *, count(*) over (partition by page_id, k) members, {DOTTED.format('src')} want, {DOTTED.format('dst')} has, trim(regexp_replace(t, '([.]{{2,}}|[…‥]+|・{{2,}}|。{{2,}})$', '')) bare from l)
  select page_id, id, case when k is null or members < 2 or t = '' or want = has then dst when want then bare || '...' when bare = '' then dst else bare end dst from n""")
def g12(s: SparkSession, d: str) -> DataFrame:
    return regions.with_linked_tails(_regions(s, d)).select("page_id", "id", "dst")


@query("f1_mark_cleanup", oracle="""
  with a as (select page_id, id, dst, trim(coalesce(dst, '')) t, coalesce(src, '') s from regions),
  b as (select *, regexp_matches(s, '[—–―─━〜～]|ー{2,}|(^|\\s)-+(\\s|$)') dash, regexp_matches(s, '^["“‘«「『（(\\[【\\s]*([…‥]|[.．・][.．・])') dots, regexp_matches(s, '^["“‘«「『（(\\[【\\s]*[,.;:!?…‥・·、。，；：！？—–ー~〜～-]') lead from a),
  c as (select *, regexp_replace(t, '^(["“\\s]*(([…‥]|[.．・][.．・])[.．・…‥]*)?["“\\s]*)[-—–]+\\s*', '\\1') u from b),
  e as (select *, case when t = '' then dst when dash then coalesce(nullif(trim(u), ''), dst)
    else coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(u, '(\\s*[—–]+|\\s+-+)(["”\\s]*)$', '\\2'), '\\s*[—–]+\\s*', ', ', 'g'), ',\\s*,+', ',', 'g'), '\\s+,', ',', 'g')), ''), dst) end one from c),
  f as (select *, case when trim(coalesce(one, '')) = '' or dots then one else coalesce(nullif(trim(regexp_replace(one, '^(["“\\s]*)([…‥]|[.．・][.．・])[.．・…‥]*\\s*', '\\1')), ''), one) end two from e)
  select page_id, id, case when trim(coalesce(two, '')) = '' or lead then two else coalesce(nullif(trim(regexp_replace(two, '^(["“\\s]*)([,.;:!?…‥・·、。，；：！？—–ー~〜～-]+\\s*)', '\\1')), ''), two) end text from f""")
def f1(s: SparkSession, d: str) -> DataFrame:
    return _regions(s, d).select("page_id", "id", regions.without_added_marks(F.col("dst"), F.col("src")).alias("text"))


@query("f2_normalised", oracle="""
  select page_id, id, regexp_replace(regexp_replace(replace(replace(replace(replace(concat(dst, ' ×’'), '“', '"'), '”', '"'), '’', ''''), '×', 'x'), '-{2,}', '—', 'g'), '[*]([^*]+)[*]', '\\1', 'g') text
  from regions where dst is not null""")
def f2(s: SparkSession, d: str) -> DataFrame:
    return _regions(s, d).where("dst is not null").select("page_id", "id", regions.plain_text(F.concat("dst", F.lit(" \u200b×’"))).alias("text"))


@query("f4_escapes", oracle="select page_id, id, concat(coalesce(dst, ''), chr(10), coalesce(src, '')) text from regions")
def f4(s: SparkSession, d: str) -> DataFrame:
    return _regions(s, d).select("page_id", "id", kernels.with_breaks(F.concat(F.coalesce("dst", F.lit("")), F.lit("\\n"), F.coalesce("src", F.lit("")))).alias("text"))


ROUTES = "select 'skipped' route, false cleans union all select 'kept', false"


@query("a3_clean_report", oracle=f"""
  with b as (select case m % 6 when 0 then 'skipped' when 1 then 'kept' when 2 then 'flat fill' when 3 then 'pattern copy' else 'neural' end route, m from regions)
  select route, count(*) n, count(*) filter (where m % 7 = 0) core_only, count(*) filter (where m % 4 = 0) second_pass, count(*) filter (where m % 9 = 0) redrawn, route not in ('skipped', 'kept') cleans,
    (select count(*) from b where route not in ('skipped', 'kept')) total from b group by route""")
def a3(s: SparkSession, d: str) -> DataFrame:
    m = F.col("m")
    route = F.when(m % 6 == 0, "skipped").when(m % 6 == 1, "kept").when(m % 6 == 2, "flat fill").when(m % 6 == 3, "pattern copy").otherwise("neural")
    return regions.cleaning_report(_regions(s, d).select(route.alias("route"), (m % 7 == 0).alias("core_only"), (m % 4 == 0).alias("second_pass"), (m % 9 == 0).alias("redrawn")), s.sql(ROUTES))


LOW = "select distinct w from (select unnest(regexp_extract_all(text, '[A-Za-z]+')) w from scenes) x where regexp_matches(w, '^[a-z]{3,}$')"
#: The fold of names, stated apart from the operator: in SQL, with repeats taken out letter by letter.
FOLD = """array_to_string(list_filter(string_split({x}, ''), lambda c, i: i = 1 or c <> string_split({x}, '')[i - 1]), '')"""
SPELT = "regexp_replace(regexp_replace(regexp_replace(replace(replace(regexp_replace({0}, '^(..+?)(sama|san|chan|kun|dono|senpai|sensei|tan|shi)$', '\\1'), 'l', 'r'), 'v', 'b'), 'ou|oh|oo|ow', 'o', 'g'), 'uu|uh', 'u', 'g'), 'ei|ee', 'e', 'g')"
KEY = FOLD.replace("{x}", SPELT)
CAPITAL = f"""
  select page_id, ord, i, w, lower(w) low from (select page_id, ord, unnest(regexp_extract_all(text, '[A-Za-z]+')) w, generate_subscripts(regexp_extract_all(text, '[A-Za-z]+'), 1) i from scenes) x
  where length(w) >= 3 and regexp_matches(w, '^[A-Z]') and lower(w) not in ({', '.join(repr(x) for x in [*names.TITLES, *names.COMMON])}) and lower(w) not in ({LOW})"""


@query("a4_name_variants", oracle=f"""
  with c as (select *, {KEY.format('low')} key from ({CAPITAL}) q), each as (select key, low, count(*) uses, min_by(w, page_id * 1000000 + ord * 1000 + i) spelling from c group by key, low),
  refs as (select key, low, string_agg('p' || page_id || ' l' || ord, ', ' order by page_id, ord) refs from (select *, row_number() over (partition by key, low order by page_id, ord) r from (select distinct key, low, page_id, ord from c) y) z where r <= 4 group by key, low)
  select e.key, e.spelling, e.uses, r.refs from each e join refs r on r.key = e.key and r.low = e.low where e.key in (select key from each group by key having count(*) > 1)""")
def a4(s: SparkSession, d: str) -> DataFrame:
    return names.variants(view(s, d, "scenes"))


@query("a7_observed_lowercase", oracle=f"select w word from ({LOW}) q")
def a7(s: SparkSession, d: str) -> DataFrame:
    return names.lower_seen(view(s, d, "scenes"))


@query("a8_proper_names", oracle="""
  with p as (select page_id, ord, unnest(regexp_extract_all(text, '[^A-Za-z]*[A-Za-z][A-Za-z''’-]*')) piece, generate_subscripts(regexp_extract_all(text, '[^A-Za-z]*[A-Za-z][A-Za-z''’-]*'), 1) i from scenes),
  q as (select page_id, ord, i - 1 "at", rtrim(regexp_extract(piece, '^([^A-Za-z]*)', 1)) before, regexp_replace(regexp_extract(piece, '([A-Za-z][A-Za-z''’-]*)$', 1), '[''’]s$', '') name from p),
  n as (select * from q where regexp_matches(name, '^[A-Z]') and length(name) > 2 and not ("at" = 0 and before = '') and not (before <> '' and contains('.!?…"''“”', right(before, 1))) and lower(name) not in (select lower(name) from q where regexp_matches(name, '^[a-z]')))
  select name, page_id, ord, "at" from (select *, row_number() over (partition by name order by page_id, ord, "at") r from n) z where r = 1""")
def a8(s: SparkSession, d: str) -> DataFrame:
    return names.names_in(view(s, d, "scenes")).withColumn("at", F.col("at").cast("long"))


@query("a5_lost_honorifics", oracle="""
  select page_id, id from regions where regexp_matches(coalesce(src, ''), '[ァ-ヶ][ァ-ヶー]+(さん|様|ちゃん|くん|殿)') and not regexp_matches(coalesce(dst, ''), '(?i)[A-Z][A-Za-z]+-(sama|san|chan|kun|dono|senpai|sensei|tan|shi)')""")
def a5(s: SparkSession, d: str) -> DataFrame:
    return regions.honorifics_lost(_regions(s, d)).select("page_id", "id")


@query("a5_leaked_honorifics", oracle="""
  with l as (select page_id, ord, unnest(regexp_extract_all(coalesce(dst, ''), '[A-Z][A-Za-z]+-san')) hit from regions where (m // 3) % 18 <> 10 or m % 3 = 0)
  select * from l where (select count(*) from l) <= greatest(3, (select count(*) from regions where (m // 3) % 18 <> 10 or m % 3 = 0) // 20)""")
def a5_leaked(s: SparkSession, d: str) -> DataFrame:
    return regions.honorifics_leaked(_regions(s, d).where("(m div 3) % 18 <> 10 or m % 3 = 0"))


PERSONS = "list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(lower(coalesce({0}, '')), '[a-z]+'), lambda w: case when w in ('i', 'me', 'my', 'mine') then '1s' when w in ('you', 'your', 'yours') then '2' when w in ('we', 'us', 'our', 'ours') then '1p' when w in ('he', 'him', 'his', 'she', 'her', 'hers', 'they', 'them', 'their') then '3' end), lambda x: x is not null)))"


@query("a11_persons", oracle=f"""
  with p as (select {PERSONS.format('dst')} a, {PERSONS.format('nxt')} b from (select src, dst, lead(dst) over (partition by page_id order by ord) nxt from regions) r where not regexp_matches(coalesce(src, ''), '私|僕|俺|あたし|わたし|我々|あなた|君|きみ|お前|彼|彼女'))
  select count(*) unnamed, count(*) filter (where len(a) > 0 and len(b) > 0) named_by_both, count(*) filter (where len(a) > 0 and len(b) > 0 and a <> b) disagree from p""")
def a11(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    rows = _regions(s, d).select(F.col("src").alias("source"), F.col("dst").alias("reference"), F.lead("dst").over(Window.partitionBy("page_id").orderBy("ord")).alias("candidate"))
    return evaluate.who_differs(rows)


@query("m3_canonical_names", oracle=f"select distinct low, {KEY.format('low')} canon from (select lower(w) low from (select unnest(regexp_extract_all(text, '[A-Za-z]+')) w from scenes) x) y")
def m3(s: SparkSession, d: str) -> DataFrame:
    words = view(s, d, "scenes").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1))).alias("w"))
    return words.select(F.lower("w").alias("low")).distinct().select("low", names.key(F.col("low")).alias("canon"))


CAST = "select 'Lady Leonora Lancaster' name, 1 place union all select 'Glow', 2 union all select 'Old Keiko', 3"
TERMS = "select 'Tarou (a coin)' term, 1 place union all select 'The Leonore house', 2 union all select 'Adae', 3"


@query("m4_canonical_table", oracle="select * from (values ('reonora', 'Leonora'), ('rancaster', 'Lancaster'), ('gro', 'Glow'), ('keko', 'Keiko'), ('taro', 'Tarou'), ('reonore', 'Leonore'), ('adae', 'Adae')) t(key, word)")
def m4(s: SparkSession, d: str) -> DataFrame:
    return names.canon_table(s.sql(CAST), s.sql(TERMS))


@query("m5_enforced_spellings", oracle="""
  select page_id, ord, replace(replace(replace(text, 'Glou', 'Glow'), 'Grow', 'Glow'), 'Keeko', 'Keiko') text,
    array_to_string(list_distinct(list_transform(regexp_extract_all(text, 'Ada'), lambda x: x || ' / Adae')), ', ') notes from scenes""")
def m5(s: SparkSession, d: str) -> DataFrame:
    return names.enforced(view(s, d, "scenes"), m4(s, d))


@query("j19_known_names", oracle=f"""
  with n as (select distinct low from ({CAPITAL}) q), k as (select low, {KEY.format('low')} key from n), s as (select * from (values ('Leonora', 1), ('Glow', 2), ('Keiko', 3), ('Adda', 4), ('Momoo', 5)) t(known, place)),
  t as (select known, place, {KEY.format('lower(known)')} key from s),
  m as (select k.low name, t.known, t.place from k join t on k.key = t.key or (length(k.key) >= 5 and length(t.key) >= 5 and levenshtein(k.key, t.key) <= 1))
  select name, min_by(known, place) known from m group by name""")
def j19(s: SparkSession, d: str) -> DataFrame:
    known = s.createDataFrame([("Leonora", 1), ("Glow", 2), ("Keiko", 3), ("Adda", 4), ("Momoo", 5)], "known string, place int")
    return names.known_as(names.name_words(view(s, d, "scenes")).select(F.col("low").alias("name")), known)


@query("u2_ordered_set_union", oracle="""
  with w as (select page_id % 7 series, page_id * 100000 + ord * 100 + i seq, w label from (select page_id, ord, unnest(regexp_extract_all(text, '[A-Za-z]+')) w, generate_subscripts(regexp_extract_all(text, '[A-Za-z]+'), 1) i from scenes) x),
  f as (select series, lower(label) low, min(seq) seq, min_by(label, seq) label from w group by series, lower(label))
  select series, label, place from (select *, row_number() over (partition by series order by seq, low) place from f) g where place <= 12""")
def u2(s: SparkSession, d: str) -> DataFrame:
    words = view(s, d, "scenes").select((F.col("page_id") % 7).alias("series"), "page_id", "ord", F.posexplode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1))).alias("i", "label"))
    rows = words.select("series", "label", (F.col("page_id") * 100000 + F.col("ord") * 100 + F.col("i") + 1).alias("seq"))
    return regions.remembered(rows, first=12).withColumn("place", F.col("place").cast("long"))


# Settings ---------------------------------------------------------------------------------------------------------------------------
@query("s8_redaction", oracle="""
  select event_id, k key, case when regexp_matches(lower(k), '(key|token|secret|password)$') then '' else v end value from (
    select event_id, 'api_key' k, props v from @events union all select event_id, 'Bot_Token', event_type from @events union all select event_id, 'theme', event_type from @events) e""")
def s8(s: SparkSession, d: str) -> DataFrame:
    rows = s.read.parquet(f"{d}/events.parquet").select("event_id", F.create_map(F.lit("api_key"), "props", F.lit("Bot_Token"), "event_type", F.lit("theme"), "event_type").alias("m"))
    return rows.select("event_id", F.explode(settings.without_secrets(F.col("m"))).alias("key", "value"))


@query("s8_reports_dropped", oracle="""
  select event_id, k key, v value from (select event_id, 'api_key' k, case when event_id % 3 = 0 then 'set' when event_id % 3 = 1 then 'env' else 'real' end v from @events union all select event_id, 'mode', 'set' from @events) e
  where not (k = 'api_key' and v in ('set', 'env'))""")
def s8_in(s: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id") % 3
    rows = s.read.parquet(f"{d}/events.parquet").select("event_id", F.create_map(F.lit("api_key"), F.when(n == 0, "set").when(n == 1, "env").otherwise("real"), F.lit("mode"), F.lit("set")).alias("m"))
    return rows.select("event_id", F.explode(settings.without_reports(F.col("m"))).alias("key", "value"))


@query("s18_env_precedence", oracle="""
  with c as (select c_custkey owner, c_custkey % 4 k from @customer)
  select owner, 'TOKEN' name, case k when 0 then 'first ' || owner else 'second#' || owner end value from c
  union all select owner, 'A', case when k = 2 then 'x y' else 'z' end from c union all select owner, 'Q_OWN', 'mine' from c""")
def s18(s: SparkSession, d: str) -> DataFrame:
    c = s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("owner"), (F.col("c_custkey") % 4).alias("k"))
    first = F.concat(F.lit("﻿export TOKEN = '"), F.when(F.col("k") == 0, F.concat(F.lit("first "), "owner")).otherwise(""), F.lit("'\r\n# A=no\n\n a="), F.when(F.col("k") == 2, '"x y"').otherwise(""), F.lit("\nnothing\n"))
    second = F.concat(F.lit("TOKEN=second#"), "owner", F.lit("\nA=y\nA=z\n"))
    files = c.select("owner", F.lit(1).alias("rank"), first.alias("text")).union(c.select("owner", F.lit(2), second))
    environment = c.select("owner", F.explode(F.create_map(F.lit("TOKEN"), F.lit("no"), F.lit("Q_OWN"), F.lit("mine"), F.lit("OTHER"), F.lit("no"))).alias("name", "value"))
    return settings.answers(settings.env_entries(files), environment, "Q_")


@query("s22_config_keeps_old_values", oracle="""
  select coalesce(n.key, o.key) key, coalesce(n.value, o.value) value from (select event_type key, max(event_id) value from @events group by event_type) o
  full outer join (select event_type key, max(event_id) + 1 value from @events where event_type <> 'view' group by event_type union all select 'extra', 1) n on o.key = n.key""")
def s22(s: SparkSession, d: str) -> DataFrame:
    e = s.read.parquet(f"{d}/events.parquet")
    old = e.groupBy(F.col("event_type").alias("key")).agg(F.max("event_id").alias("value"))
    new = old.where("key <> 'view'").withColumn("value", F.col("value") + 1).union(s.sql("select 'extra' key, 1L value"))
    return settings.seeded(old, new)


@query("m6_settings_migration", oracle="""
  select event_id, k key, v value from (select event_id, 'engine' k, case when event_id % 4 = 0 then 'explicit' when event_type = 'click' then 'fast' else event_type end v from @events union all select event_id, 'size', '12' from @events) e""")
def m6(s: SparkSession, d: str) -> DataFrame:
    e = s.read.parquet(f"{d}/events.parquet")
    old = F.create_map(F.lit("old_engine"), "event_type", F.lit("size"), F.lit("12"))
    new = F.when(F.col("event_id") % 4 == 0, F.map_concat(old, F.create_map(F.lit("engine"), F.lit("explicit")))).otherwise(old)
    return e.select("event_id", F.explode(settings.migrated(new, [("old_engine", "engine", {"click": "fast"})])).alias("key", "value"))


@query("p14_default_on", oracle="select event_id, coalesce(json_extract_string('{\"a\": ' || case event_id % 3 when 0 then 'true' when 1 then 'false' else 'null' end || '}', '$.a') <> 'false', true) enabled from @events")
def p14(s: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id") % 3
    stored = F.concat(F.lit('{"a": '), F.when(n == 0, "true").when(n == 1, "false").otherwise("null"), F.lit("}"))
    return s.read.parquet(f"{d}/events.parquet").select("event_id", settings.on(F.from_json(stored, "a boolean")["a"]).alias("enabled"))


@query("f11_font_cascade", oracle="""
  select page_id, id, case when m % 13 = 0 and m % 2 = 0 then 'hand' when kind = 'sfx' then 'brush' when page_id % 2 = 0 then 'house' else 'plain' end font from regions""")
def f11(s: SparkSession, d: str) -> DataFrame:
    m = F.col("m")
    hand = F.when(m % 13 == 0, F.when(m % 2 == 0, "hand").otherwise("lost.ttf"))
    found = settings.font(hand, F.when(m % 5 == 1, "gone.ttf"), F.when(F.col("kind") == "sfx", "brush"), F.when(F.col("page_id") % 2 == 0, "house"), usable=["plain", "hand", "brush", "house"])
    return _regions(s, d).select("page_id", "id", found.alias("font"))


@query("f14_style_precedence", oracle="""
  select page_id, id, k key, v value from (select page_id, id, 'fill' k, case when m % 5 = 0 then 'red' when m % 3 = 0 then 'grey' else 'black' end v from regions union all select page_id, id, 'stroke', case when m % 3 = 0 then '2' else '1' end from regions
    union all select page_id, id, 'glow', 'on' from regions where m % 5 = 0) r""")
def f14(s: SparkSession, d: str) -> DataFrame:
    m, none = F.col("m"), F.create_map().cast("map<string,string>")
    hand = F.when(m % 5 == 0, F.create_map(F.lit("fill"), F.lit("red"), F.lit("glow"), F.lit("on"))).otherwise(none)
    measured = F.when(m % 3 == 0, F.create_map(F.lit("fill"), F.lit("grey"), F.lit("stroke"), F.lit("2"))).otherwise(none)
    automatic = F.create_map(F.lit("fill"), F.lit("black"), F.lit("stroke"), F.lit("1"))
    return _regions(s, d).select("page_id", "id", F.explode(settings.styled(hand, measured, automatic)).alias("key", "value"))


@query("f20_masked_secrets", oracle="select event_id, case when trim(coalesce(case when event_id % 3 = 0 then ' ' else props end, '')) <> '' then 'set' else '' end state from @events")
def f20(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/events.parquet").select("event_id", settings.masked(F.when(F.col("event_id") % 3 == 0, " ").otherwise(F.col("props"))).alias("state"))


# Costs ------------------------------------------------------------------------------------------------------------------------------
def _ratio(real: str, predicted: str, low: str, high: str, zero: bool = False) -> str:
    return f"case when {predicted} > 0 {'' if zero else f'and {real} > 0'} then least({high}, greatest({low}, cast({real} as double) / {predicted})) else 1.0 end"


@query("a15_drift_regimes", oracle=f"""
  with n as (select *, row_number() over (partition by step, model, think_off order by seq desc) r from runs where boxes >= 20 and ptin + pcached > 0 and ptout > 0),
  t as (select step, model, think_off, count(*) runs, sum(tin + cached) rin, sum(ptin + pcached) pin, coalesce(sum(greatest(0, tout - think)) filter (where think is not null), 0) rvis, coalesce(sum(greatest(0, ptout - pthink)) filter (where think is not null), 0) pvis,
    coalesce(sum(think), 0) rthk, coalesce(sum(pthink) filter (where think is not null), 0) pthk, coalesce(sum(tout) filter (where think is null), 0) rout, coalesce(sum(ptout) filter (where think is null), 0) pout from n where r <= 8 group by 1, 2, 3)
  select step, model, think_off, runs, round({_ratio('rin', 'pin', '0.2', '2.5')}, 6) input, round(case when pvis > 0 or pthk > 0 then {_ratio('rvis', 'pvis', '0.75', '1.25')} else {_ratio('rout', 'pout', '0.2', '2.5')} end, 6) visible,
    round(case when pvis > 0 or pthk > 0 then {_ratio('rthk', 'pthk', '0.2', '2.5', True)} else {_ratio('rout', 'pout', '0.2', '2.5')} end, 6) thinking from t""")
def a15(s: SparkSession, d: str) -> DataFrame:
    out = cost.drift(view(s, d, "runs"))
    return out.select("step", "model", "think_off", "runs", *[F.round(c, 6).alias(c) for c in ("input", "visible", "thinking")])


@query("a16_meter_evidence", oracle="select step, model, bool_or(think > 0) thinks from (select *, row_number() over (partition by step, model order by seq desc) r from runs where boxes >= 20 and think is not null) n where r <= 8 group by step, model")
def a16(s: SparkSession, d: str) -> DataFrame:
    return cost.thinks(view(s, d, "runs"))


@query("a18_bill", oracle="""
  select page, sum(tin)::bigint tin, sum(tout)::bigint tout, count(think) told, sum(think)::bigint think, round(sum(case when direct > 0 then direct else coalesce((tin * r.rin + tout * r.rout) / 1e6, 0.0) end), 6) cost, count(*) calls
  from (select seq % 50 page, model, tin, tout, think, case seq % 3 when 0 then 0.0 when 1 then seq / 1e4 end direct from runs) c left join (values ('m0', 3, 15), ('m1', 1, 5), ('m3', 10, 30)) r(model, rin, rout) on r.model = c.model group by page""")
def a18(s: SparkSession, d: str) -> DataFrame:
    n = F.col("seq") % 3
    calls = view(s, d, "runs").select((F.col("seq") % 50).alias("run"), "model", "tin", "tout", "think", F.when(n == 0, F.lit(0.0)).when(n == 1, F.col("seq") / 1e4).alias("direct"))
    rates = s.createDataFrame([("m0", 3, 15), ("m1", 1, 5), ("m3", 10, 30)], "model string, rin int, rout int")
    return cost.bill(calls, rates).withColumnRenamed("run", "page").withColumn("cost", F.round("cost", 6))


@query("a19_usage_shapes", oracle="""
  select event_id, case event_id % 4 when 0 then event_id when 1 then greatest(0, event_id - 10) else 0 end tin, case when event_id % 4 < 2 then event_id % 7 else 0 end tout, case event_id % 4 when 0 then event_id % 5 when 1 then 10 else 0 end cached,
    case when event_id % 4 = 0 then 3 else 0 end written, case event_id % 4 when 1 then event_id % 3 when 2 then 9 end think, case when event_id % 4 = 1 then 0.5 else 0.0 end cost from @events""")
def a19(s: SparkSession, d: str) -> DataFrame:
    e, n = F.col("event_id"), F.col("event_id") % 4
    one = F.format_string('{"usage": {"input_tokens": %d, "output_tokens": %d, "cache_read_input_tokens": %d, "cache_creation_input_tokens": 3}}', e, e % 7, e % 5)
    other = F.format_string('{"usage": {"prompt_tokens": %d, "completion_tokens": %d, "prompt_tokens_details": {"cached_tokens": 10}, "completion_tokens_details": {"reasoning_tokens": %d}, "cost": 0.5}}', e, e % 7, e % 3)
    reply = F.when((n == 0) & (e % 5 > 0), one).when(n == 0, F.regexp_replace(one, '"cache_read_input_tokens": 0, ', "")).when(n == 1, other).when(n == 2, '{"usage": {"thoughts_token_count": 9}}').otherwise("no reply")
    return s.read.parquet(f"{d}/events.parquet").select("event_id", cost.usage(reply).alias("u")).select("event_id", "u.*")


@query("a20_token_estimate", oracle="""
  select page_id, id, cast(round_even(1.25::decimal(4,2) * len(regexp_extract_all(rest, '[A-Za-z0-9]+')) + 0.95::decimal(4,2) * (length(t) - length(rest)) + 0.63::decimal(4,2) * length(regexp_replace(rest, '[A-Za-z0-9\\s]', '', 'g')), 0) as bigint) tokens
  from (select *, regexp_replace(t, '[⺀-鿿가-힯豈-﫿＀-￯　-〿]', '', 'g') rest from (select page_id, id, concat(coalesce(src, ''), ' ', coalesce(dst, '')) t from regions) q) r""")
def a20(s: SparkSession, d: str) -> DataFrame:
    return _regions(s, d).select("page_id", "id", cost.tokens(F.concat(F.coalesce("src", F.lit("")), F.lit(" "), F.coalesce("dst", F.lit("")))).alias("tokens"))


@query("a22_reply_cap", oracle="select seq, cast(case when boxes <= 0 then 8000 else least(8000, greatest(1500, floor(2 * (60 + 20 * boxes + 2 * (predicted // 10) + case when model = 'm3' then 900 else 0 end)))) end as bigint) cap from meter")
def a22(s: SparkSession, d: str) -> DataFrame:
    cap = cost.reply_cap(F.col("boxes"), F.expr("predicted div 10"), F.lit(60), F.lit(20), F.lit(2), F.when(F.col("model") == "m3", 900).otherwise(0))
    return view(s, d, "meter").select("seq", cap.alias("cap"))


# Sequences and text ----------------------------------------------------------------------------------------------------------------
MARKS = """
  marks as (select strip_id, (min(row_no) + max(row_no) + 1) // 2 mark from (select strip_id, row_no, row_no - row_number() over (partition by strip_id order by row_no) g from strip_rows where flat) f group by strip_id, g having count(*) >= 6),
  sizes as (select strip_id, count(*) length from strip_rows group by strip_id)"""


@query("w6_nearest_cuts", oracle=f"""
  with recursive {MARKS.strip()}, cut as (
    select strip_id, length, cast(0 as bigint) n, cast(0 as bigint) at_row from sizes
    union all
    select c.strip_id, c.length, c.n + 1, coalesce((select arg_min(mark, abs(mark - c.at_row - 100) * 1000000 + mark) from marks m where m.strip_id = c.strip_id and mark > c.at_row + 45 and mark < c.at_row + 190),
      (select min(mark) from marks m where m.strip_id = c.strip_id and mark > c.at_row + 190)) from cut c
    where c.at_row is not null and c.length - c.at_row > 190)
  select strip_id, n - 1 n, at_row from cut where n > 0 and at_row is not null""")
def w6(s: SparkSession, d: str) -> DataFrame:
    """Gutters are the middles of bands of six empty rows or more."""
    import pandas as pd

    from quire.operators import sequence

    rows = view(s, d, "strip_rows")
    bands = sequence.islands(rows, least=6).select("strip_id", F.expr("(first_row + last_row + 1) div 2").alias("mark"))
    marks = bands.groupBy("strip_id").agg(F.sort_array(F.collect_list("mark")).alias("marks"))
    sizes = rows.groupBy("strip_id").agg(F.count("*").alias("length")).join(marks, "strip_id", "left")

    def cut(batches):
        for x in batches:
            found = [(k, n, at) for k, length, m in zip(x.strip_id, x.length, x.marks) for n, at in enumerate(greedy.nearest_cuts([] if m is None else list(map(int, m)), int(length), 100))]
            yield pd.DataFrame(found, columns=["strip_id", "n", "at_row"])

    return sizes.select("strip_id", "length", "marks").mapInPandas(cut, "strip_id long, n long, at_row long")


@query("w5_bands", oracle="""
  with recursive c as (select *, y + h / 2.0 yc, row_number() over (partition by page_id order by y + h / 2.0, box_id) k, count(*) over (partition by page_id) n, row_number() over (partition by page_id order by h) hk from boxes),
  med as (select page_id, h m from c where hk = n // 2 + 1),
  f as (select c.page_id, c.k, c.yc head, c.box_id, c.x, c.y from c where k = 1
    union all select c.page_id, c.k, case when c.yc - f.head <= 0.6 * med.m then f.head else c.yc end, c.box_id, c.x, c.y from f join c on c.page_id = f.page_id and c.k = f.k + 1 join med on med.page_id = f.page_id)
  select page_id, box_id, row_number() over (partition by page_id order by head, x, y, k) - 1 place from f""")
def w5(s: SparkSession, d: str) -> DataFrame:
    from quire.plans.grouped_queries import BOX, _placed

    return greedy.per_page(view(s, d, "boxes"), lambda p: _placed(p, greedy.bands(greedy.as_boxes(p))), BOX + ", place long")


DICTIONARY = ["UTF-8", "LEFTHYPHENMIN 2", "% a comment", "t1h", "n1d", "e1r", "1tion", "a1t", "r1e", "he2n", "hen5at", "a1b=c", ".an2", "o2n.", "1ti2", "NOHYPHEN -"]


@query("s23_hyphenation_patterns", oracle="""select * from (values ('th', 1, 1), ('nd', 1, 1), ('er', 1, 1), ('tion', 0, 1), ('at', 1, 1), ('re', 1, 1), ('hen', 2, 2), ('henat', 3, 5), ('.an', 3, 2), ('on.', 1, 2), ('ti', 0, 1), ('ti', 2, 2)) t(letters, "at", level)""")
def s23(s: SparkSession, d: str) -> DataFrame:
    return kernels.hyphenation_patterns(s.createDataFrame([(x,) for x in DICTIONARY], "line string"))


@query("f7_hyphenation", oracle="""
  with p as (select * from (values ('th', 1, 1), ('nd', 1, 1), ('er', 1, 1), ('tion', 0, 1), ('at', 1, 1), ('re', 1, 1), ('hen', 2, 2), ('henat', 3, 5), ('.an', 3, 2), ('on.', 1, 2), ('ti', 0, 1), ('ti', 2, 2)) t(letters, "at", level)),
  w as (select distinct tok word from tokens), s as (select word, '.' || lower(word) || '.' w, unnest(range(1, length(word) + 3)) k from w where length(word) >= 5),
  m as (select s.word, k - 2 + p."at" place, max(level) level from s join p on substr(s.w, k, length(p.letters)) = p.letters group by 1, 2),
  b as (select word, list(cast(place as integer) order by place) points from m where level % 2 = 1 and place >= 2 and place <= length(word) - 3 group by word)
  select w.word, coalesce(b.points, []) points from w left join b on b.word = w.word""")
def f7(s: SparkSession, d: str) -> DataFrame:
    return kernels.hyphenation(view(s, d, "tokens").select(F.col("tok").alias("word")), s23(s, d))


@query("f3_comparison_form", oracle="select page_id, ord, regexp_replace(replace(text, '…', '...'), '\\s', '', 'g') form from said")
def f3(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "said").select("page_id", "ord", kernels.nfkc("text").alias("form"))


@query("a10_chrf", oracle="""
  with p as (select row_number() over (order by page_id, ord) id, regexp_replace(text, '\\s', '', 'g') h, regexp_replace(nxt, '\\s', '', 'g') r from (select *, lead(text) over (partition by page_id order by ord) nxt from said) q where nxt is not null),
  o as (select unnest(range(1, 7)) n), hg as (select id, n, substr(h, i, n) g, count(*) c from (select id, n, h, unnest(range(1, length(h) - n + 2)) i from p, o) x group by 1, 2, 3),
  rg as (select id, n, substr(r, i, n) g, count(*) c from (select id, n, r, unnest(range(1, length(r) - n + 2)) i from p, o) x group by 1, 2, 3),
  m as (select hg.n, sum(least(hg.c, rg.c)) m from hg join rg on rg.id = hg.id and rg.n = hg.n and rg.g = hg.g group by hg.n),
  t as (select o.n, coalesce(m.m, 0) m, (select sum(c) from hg where hg.n = o.n) h, (select sum(c) from rg where rg.n = o.n) r from o left join m on m.n = o.n),
  a as (select coalesce(avg(m::double / h) filter (where h > 0), 0) p, coalesce(avg(m::double / r) filter (where r > 0), 0) r from t)
  select round(p, 6) precision_, round(r, 6) recall, round(case when p + r > 0 then 100 * 5 * p * r / (4 * p + r) else 0.0 end, 4) chrf from a""")
def a10(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    nxt = F.lead("text").over(Window.partitionBy("page_id").orderBy("ord"))
    return evaluate.chrf(view(s, d, "said").select(F.col("text").alias("hypothesis"), nxt.alias("reference")).where("reference is not null"))


@query("s12_template_round_trip", oracle="select cast(page_id as varchar) page, cast(id + 1 as integer) n, trim(dst) english from regions where trim(coalesce(dst, '')) <> '' union all select 'j' || page_id, cast(id + 1 as integer), trim(dst) from regions where trim(coalesce(dst, '')) <> ''")
def s12(s: SparkSession, d: str) -> DataFrame:
    """Templates as text and as JSON, filled in, and read back."""
    import json

    import pandas as pd

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        page, dst = str(rows.page_id.iloc[0]), [x or "" for x in rows.dst]
        text = formats.template([(page, int(o) + 1, "source", t) for o, t in zip(rows.id, dst)])
        doc = json.dumps({"pages": [{"page": "j" + page, "boxes": [{"n": int(o) + 1, "japanese": "source", "english": t} for o, t in zip(rows.id, dst)]}]})
        return pd.DataFrame(formats.filled_in("# a note\n" + text) + formats.filled_in(doc), columns=["page", "n", "english"])

    return _regions(s, d).select("page_id", "id", "dst").groupBy("page_id").applyInPandas(run, "page string, n int, english string")


@query("m2_people_merge")
def m2(s: SparkSession, d: str) -> DataFrame:
    """Names of each series as they come; evidence is what its lines write."""
    import pandas as pd

    lines = view(s, d, "scenes").select((F.col("page_id") % 50).alias("series"), "page_id", "ord", "text")
    adds = lines.select("series", "page_id", "ord", F.posexplode(F.regexp_extract_all("text", F.lit("([A-Z][a-z]+(?: [A-Z][a-z]+)?)"), F.lit(1))).alias("at", "name"))
    first = adds.groupBy("series", "name").agg(F.min(F.struct("page_id", "ord", "at")).alias("w"))
    evidence = adds.where("page_id % 3 > 0").groupBy("series").agg(F.collect_set(names.key(F.col("name"))).alias("evidence"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["p", "o", "a"])
        seen = set(rows.evidence.iloc[0]) if rows.evidence.iloc[0] is not None else set()
        out = names.merged_people([("Leonora", "")], [(n, "") for n in rows.name], seen)
        return pd.DataFrame([(int(rows.series.iloc[0]), n, why) for n, _, why in out], columns=["series", "name", "outcome"])

    rows = first.join(evidence, "series", "left").select("series", "name", F.col("w.page_id").alias("p"), F.col("w.ord").alias("o"), F.col("w.at").alias("a"), "evidence")
    return rows.groupBy("series").applyInPandas(run, "series long, name string, outcome string")


@query("f6_canonical_forms", oracle=f"select distinct low word, {KEY.format('low')} form from (select lower(tok) low from tokens where regexp_matches(tok, '^[A-Za-z]+$')) t")
def f6(s: SparkSession, d: str) -> DataFrame:
    words = view(s, d, "tokens").where(F.col("tok").rlike("^[A-Za-z]+$")).select(F.lower("tok").alias("word")).distinct()
    return words.select("word", names.key(F.col("word")).alias("form"))


# Pages ------------------------------------------------------------------------------------------------------------------------------
TOKEN = "case when locked then id || '|locked' else concat_ws('|', id, kind, w, coalesce(dst, '-')) end"


@query("f15_fingerprints", oracle=f"select page_id, sha1(string_agg({TOKEN}, chr(10) order by id)) fingerprint from regions group by page_id")
def f15(s: SparkSession, d: str) -> DataFrame:
    return pages.fingerprints(_regions(s, d), ["kind", "w", "dst"])


@query("t8_changed_pages", oracle="select distinct r.page_id from regions r where r.page_id % 10 = 0 and not locked and m % 2 = 0")
def t8(s: SparkSession, d: str) -> DataFrame:
    was = _regions(s, d).withColumn("w", F.when((F.col("page_id") % 10 == 0) & (F.col("m") % 2 == 0), F.col("w") + 1).otherwise(F.col("w")))
    return pages.changed(f15(s, d), pages.fingerprints(was, ["kind", "w", "dst"])).select("page_id")


@query("t1_carried_context", oracle="""
  with t as (select page_id % 5 series, page_id, ord, src term, coalesce(dst, '-') rendering from regions where coalesce(src, '') <> '')
  select t.*, (select min_by(rendering, e.page_id * 1000 + e.ord) from t e where e.series = t.series and e.term = t.term and e.page_id < t.page_id) canon from t""")
def t1(s: SparkSession, d: str) -> DataFrame:
    rows = _regions(s, d).where("coalesce(src, '') <> ''")
    return pages.carried(rows.select((F.col("page_id") % 5).alias("series"), "page_id", "ord", F.col("src").alias("term"), F.coalesce("dst", F.lit("-")).alias("rendering")))


SHEET = "select * from (values ('a', 'Tarel'), ('b', 'Lulu (white rabbit)'), ('c', 'Moon - the inn'), ('e', 'Old Bridge')) t(term, value)"
ADDS = "select * from (values ('a', 'Tarrel (the copper coin)'), ('b', 'Loulou (grey hare)'), ('d', 'Edel Canyon (a place)'), ('e', 'Bridge'), ('f', 'Lancaster (the ducal house)'), ('g', ' '), ('h', 'Hall of Mirrors - a hall')) t(term, value)"


@query("m1_glossary_merge", oracle="""
  select * from (values ('a', 'Tarel (the copper coin)', 'described'), ('b', 'Lulu (white rabbit)', 'kept'), ('c', 'Moon - the inn', 'kept'), ('d', null, 'a person'), ('e', 'Old Bridge', 'no note'),
    ('f', 'Lancaster (the ducal house)', 'set'), ('h', 'Hall of Mirrors (a hall)', 'set')) t(term, value, outcome)""")
def m1(s: SparkSession, d: str) -> DataFrame:
    return pages.glossary(s.sql(SHEET), s.sql(ADDS), s.createDataFrame([("Edel Lancaster",), ("Laszlo",)], "name string"))


@query("j23_page_alias", oracle="""
  with p as (select page_id, url path, regexp_extract(url, '([^/]*)$', 1) base from @pages), n as (
    select page_id, unnest([path, base, regexp_replace(base, '[.][^.]*$', ''), lower(path), lower(base), lower(regexp_replace(base, '[.][^.]*$', ''))]) alias from p)
  select alias, min(page_id) page_id from n group by alias""")
def j23(s: SparkSession, d: str) -> DataFrame:
    return pages.aliases(s.read.parquet(f"{d}/pages.parquet").select("page_id", F.col("url").alias("path")))


@query("x3_first_route", oracle="select page_id, case when max(score) > 990 then 'painted' when bool_or(kind = 'sfx' and w > 150) then 'mixed' when count(*) > 8 then 'dense' end route from boxes group by page_id")
def x3(s: SparkSession, d: str) -> DataFrame:
    route = pages.first_route(painted=F.max("score") > 990, mixed=F.max(F.when((F.col("kind") == "sfx") & (F.col("w") > 150), True)), dense=F.count("*") > 8)
    return view(s, d, "boxes").groupBy("page_id").agg(route.alias("route"))


@query("x5_user_kinds", oracle="select box_id, case kind when 'sfx' then 'custom' when 'bubble' then 'speech' when 'freefloat' then 'loose' end family from boxes")
def x5(s: SparkSession, d: str) -> DataFrame:
    return pages.families(view(s, d, "boxes"), view(s, d, "families"), s.createDataFrame([("sfx", "custom"), ("scream", "custom")], "kind string, family string")).select("box_id", "family")


@query("j29_seam_continuity", oracle="""
  with t as (select strip_id, row_no tile, 300 + row_no % 2 * 10 * (strip_id % 2) width, list_value(row_no * 29 % 200, (row_no + 1) * 53 % 200, 90, row_no % 7) top, list_value((row_no + 1) * 29 % 200, (row_no + 2) * 53 % 200, 95 + row_no % 40, row_no % 5) bottom from strip_rows),
  n as (select *, lead(top) over (partition by strip_id order by tile) up, lead(width) over (partition by strip_id order by tile) nw from t)
  select strip_id, tile from n where nw = width and list_stddev_pop(bottom) >= 20 and list_stddev_pop(up) >= 20
    and (abs(bottom[1] - up[1]) + abs(bottom[2] - up[2]) + abs(bottom[3] - up[3]) + abs(bottom[4] - up[4])) / 4.0 < 16""")
def j29(s: SparkSession, d: str) -> DataFrame:
    r = F.col("row_no")
    edge = lambda *xs: F.array(*[F.lit(x).cast("double") if isinstance(x, int) else x.cast("double") for x in xs])
    tiles = view(s, d, "strip_rows").select(
        "strip_id", r.alias("tile"), (300 + r % 2 * 10 * (F.col("strip_id") % 2)).alias("width"), edge(r * 29 % 200, (r + 1) * 53 % 200, 90, r % 7).alias("top"),
        edge((r + 1) * 29 % 200, (r + 2) * 53 % 200, 95 + r % 40, r % 5).alias("bottom"),
    )
    return pages.seams(tiles)


@query("f13_colours", oracle="""
  select page_id, id, case m % 4 when 3 then null else greatest(abs(m % 256 - 128), abs(m * 7 % 256 - 64), abs(m * 13 % 256 - 32)) end distance, case m % 4 when 0 then 255 when 1 then m * 3 % 256 when 2 then 128 end alpha from regions""")
def f13(s: SparkSession, d: str) -> DataFrame:
    m = F.col("m").cast("int")
    parts = [m % 256, m * 7 % 256, m * 13 % 256]
    kind = m % 4
    colour = (
        F.when(kind == 0, F.format_string("#%02X%02x%02x", *parts)).when(kind == 1, F.format_string(" #%02x%02x%02x%02x", *parts, m * 3 % 256)).when(kind == 2, F.format_string("rgba(%d, %d,%d, 0.5)", *parts)).otherwise("blueish")
    )
    c = pages.rgba(colour)
    return _regions(s, d).select("page_id", "id", pages.colour_distance(c, F.array(F.lit(128), F.lit(64), F.lit(32))).alias("distance"), F.element_at(c, 4).alias("alpha"))


@query("f16_formatting", oracle="""
  with p as (select page_id, count(*) n, count(*) filter (where m % 3 = 0) k, count(*) filter (where m % 2 = 0) e, string_agg('p' || page_id || ' l' || id, ', ' order by id) filter (where r <= 4 and m % 2 = 0) shown
    from (select *, row_number() over (partition by page_id, m % 2 order by id) r from regions) q group by page_id)
  select page_id, n || case when n = 1 then ' box' else ' boxes' end said, cast(round_even(100.0 * k / n, 0) as bigint) || '%' share, coalesce(shown, '') || case when e > 4 then ' and ' || (e - 4) || ' more' else '' end refs from p""")
def f16(s: SparkSession, d: str) -> DataFrame:
    own = F.when(F.col("m") % 2 == 0, F.struct(F.col("page_id").alias("page"), F.col("id").alias("line")))
    rows = _regions(s, d).groupBy("page_id").agg(F.count("*").alias("n"), F.count_if(F.col("m") % 3 == 0).alias("k"), F.sort_array(F.collect_list(own)).alias("where"))
    return rows.select("page_id", pages.counted(F.col("n"), "box", "boxes").alias("said"), pages.percent(F.col("k"), F.col("n")).alias("share"), pages.references(F.col("where")).alias("refs"))


@query("f19_error_classes", oracle="""
  select event_id, case event_id % 10 when 0 then 'key' when 1 then 'money' when 2 then 'limit' when 3 then 'model' when 4 then 'too long' when 5 then 'refused' when 6 then 'server' when 7 then 'error 418' when 8 then 'money' end class from @events""")
def f19(s: SparkSession, d: str) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, (401, 402, 429, 404, 413, 400, 503, 418, 400, 200))), (F.col("event_id") % 10 + 1).cast("int"))
    body = F.when(F.col("event_id") % 10 == 5, "Blocked by SAFETY settings").when(F.col("event_id") % 10 == 8, "You exceeded your current quota")
    return s.read.parquet(f"{d}/events.parquet").select("event_id", pages.refusal(status, body).alias("class"))


@query("f21_language_lookup", oracle="""
  select doc_id project, coalesce(case when doc_id % 9 = 0 then 'zh' end, case doc_id % 4 when 0 then 'ja' when 1 then 'ko' when 2 then 'zh' end, 'und') language, doc_id % 4 = 0 rtl from @documents""")
def f21(s: SparkSession, d: str) -> DataFrame:
    media = s.createDataFrame([("manga", "ja", True), ("manhwa", "ko", False), ("manhua", "zh", False)], "medium string, language string, rtl boolean")
    n = F.col("doc_id") % 4
    medium = F.when(n == 0, "manga").when(n == 1, "manhwa").when(n == 2, "manhua").otherwise("novel")
    projects = s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("project"), medium.alias("medium"), F.when(F.col("doc_id") % 9 == 0, "zh").when(F.col("doc_id") % 9 == 1, " ").alias("source"))
    return pages.source_language(media, projects).select("project", "language", "rtl")


@query("a28_page_cost", oracle="""
  with l as (select user_id page_id, event_type route, event_id % 30 boxes, (event_id * 37) % 900 a, (event_id * 11) % 300 b from @events)
  select page_id, count(*) loads, max_by(route, lpad((a + b)::varchar, 6, '0') || route) route, max(boxes) boxes, sum(a)::bigint load_ms, sum(b)::bigint detect_ms from l where a + b > 500 group by page_id""")
def a28(s: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    loads = s.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("page_id"), F.col("event_type").alias("route"), (e % 30).alias("boxes"), (e * 37 % 900).alias("load_ms"), (e * 11 % 300).alias("detect_ms"))
    return pages.slow_pages(loads)


@query("a2_run_report", oracle="select count(*) regions, count(*) filter (where w < 60) compact, count(*) filter (where h > 170) overflow, count(*) filter (where m % 4 = 0) flagged from regions")
def a2(s: SparkSession, d: str) -> DataFrame:
    return pages.run_report(_regions(s, d).select((F.col("w") < 60).alias("compact"), (F.col("h") > 170).alias("overflow"), F.when(F.col("m") % 4 == 0, "look").when(F.col("m") % 4 == 1, " ").alias("flagged")))


@query("a25_three_points", oracle="select step, model, 40.0 + length(step) per_page, 3.0 per_box, 0.5 per_context_box from (select distinct step, model from meter) m")
def a25(s: SparkSession, d: str) -> DataFrame:
    points = s.createDataFrame([(1, 0), (2, 0), (1, 1)], "boxes int, context int")
    rows = view(s, d, "meter").select("step", "model").distinct().join(F.broadcast(points), F.lit(True))
    return pages.three_points(rows.withColumn("usd", 40.0 + F.length("step") + 3.0 * F.col("boxes") + 0.5 * F.col("context")))


@query("u7_keys_once_offered", oracle="""
  select 'seed' what, user_id project, event_type key from (select distinct user_id, event_type from @events where event_id % 3 > 0) n where not exists (select 1 from @events e where e.user_id = n.user_id and e.event_type = n.event_type and e.event_id % 3 = 0)
  union all select distinct 'ever', user_id, event_type from @events""")
def u7(s: SparkSession, d: str) -> DataFrame:
    e = s.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("project"), F.col("event_type").alias("key"), "event_id")
    fresh, ever = pages.offered(e.where("event_id % 3 > 0").drop("event_id"), e.where("event_id % 3 = 0").drop("event_id").distinct())
    return fresh.select(F.lit("seed").alias("what"), "project", "key").union(ever.select(F.lit("ever"), "project", "key"))


@query("t3_apply_once", oracle="select uid, run, seq, coins from (select user_id uid, 'run' || event_id % 40 run, event_id seq, cast(ceil(value) as bigint) coins, row_number() over (partition by user_id, event_id % 40 order by event_id) r from @events) e where r = 1")
def t3(s: SparkSession, d: str) -> DataFrame:
    from quire.plans.grouped_queries import account_events

    return ledger.once(account_events(s, d).select("uid", "run", "seq", "coins"), ["uid", "run"])


@query("m11_expire_and_take", oracle="""
  with recursive e as (select user_id owner, event_id at_, case when event_type in ('click', 'signup') then 'put' else 'take' end kind, row_number() over (partition by user_id order by event_id) k from @events),
  f as (select owner, at_, kind, k, case when kind = 'put' then 'put' else 'nothing' end outcome, case when kind = 'put' then at_ end held from e where k = 1
    union all select e.owner, e.at_, e.kind, e.k, case when e.kind = 'put' then case when f.held is not null and e.at_ - f.held <= 120 then 'failed' else 'put' end else case when f.held is not null and e.at_ - f.held <= 120 then 'taken' else 'nothing' end end,
      case when e.kind = 'put' then case when f.held is not null and e.at_ - f.held <= 120 then f.held else e.at_ end end from f join e on e.owner = f.owner and e.k = f.k + 1)
  select owner, at_ "at", kind, outcome from f""")
def m11(s: SparkSession, d: str) -> DataFrame:
    entries = s.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("owner"), F.col("event_id").alias("at"), F.when(F.col("event_type").isin("click", "signup"), "put").otherwise("take").alias("kind"))
    return ledger.live(entries, seconds=120)


@query("m7_clawbacks", oracle="""
  with p as (select user_id charge, event_id seq, cast(ceil(value) as bigint) coins, 1000 total, (event_id * 7) % 1200 refunded from @events),
  s as (select *, case when coins <= 0 or refunded <= 0 then 0 when refunded >= total then coins else coins * refunded // total end share from p)
  select charge, seq, cast(greatest(0, share - coalesce(max(share) over (partition by charge order by seq rows between unbounded preceding and 1 preceding), 0)) as bigint) taken from s""")
def m7_clawbacks(s: SparkSession, d: str) -> DataFrame:
    e = s.read.parquet(f"{d}/events.parquet")
    rows = e.select("user_id", F.col("user_id").alias("charge"), F.col("event_id").alias("seq"), F.ceil("value").cast("long").alias("coins"), F.lit(1000).alias("total"), (F.col("event_id") * 7 % 1200).alias("refunded"))
    return ledger.clawed_back(rows).select("charge", "seq", "taken")


@query("w14_panelled_order")
def w14_panels(s: SparkSession, d: str) -> DataFrame:
    """Panels first, then the boxes of each. A page's panels are its grid of two by two."""
    from quire.plans.grouped_queries import BOX, _placed

    grid = [(i % 2 * 240, i // 2 * 230, 240, 230) for i in range(4)]
    return greedy.per_page(view(s, d, "boxes"), lambda p: _placed(p, greedy.panelled_order(greedy.as_boxes(p), grid)), BOX + ", place long")
