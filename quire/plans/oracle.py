"""Plain SQL for the results of :mod:`quire.plans.workloads`, written independently for a second engine."""

from __future__ import annotations

_WS = r"[\s\x{1C}-\x{1F}\p{Z}\x{85}\x0B]"


def _flat(text: str) -> str:
    return f"trim(regexp_replace({text}, '{_WS}+', ' ', 'g'))"


def _strip(text: str) -> str:
    return f"regexp_replace({text}, '^{_WS}+|{_WS}+$', '', 'g')"


_HEAD = "'---' || chr(10) || 'title: Document ' || doc_id || chr(10) || 'lang: ' || lang || chr(10) || '---'"
_CANON = f"case when lang = 'en' then {_HEAD} || chr(10) || text when lang = 'de' then {_HEAD} || text else text end"
_FM = rf"^---{_WS}*\n((?s:.*?))\n---{_WS}*\n"

_FILES = r"""
files as (
  select doc_id, source, case lang when 'en' then 'paper' || doc_id || '.TEX' when 'de' then '~$paper' || doc_id || '.docx'
    when 'fr' then 'paper' || doc_id || '.zip' else 'paper' || doc_id || '.md' end as name, lang
  from documents)
"""

_FINDINGS = """
found as (
  select doc_id, 'error' as level, 'required' as rule, 'Missing required field: quality' as message, 'doc-' || doc_id as file
    from documents left join labels using (doc_id) where coalesce(quality, 0) = 0
  union all
  select doc_id, 'error', 'required', 'Missing required field: lang', 'doc-' || doc_id from documents where coalesce(lang, '') = ''
  union all
  select doc_id, 'error', 'required', 'Missing required field: source', 'doc-' || doc_id from documents where coalesce(source, '') = ''
  union all
  select doc_id, 'warning', 'recommended', 'Recommended field missing: toxic', null
    from documents left join labels using (doc_id) where coalesce(toxic, 0) = 0)
"""

_BADGES = """
flags as (select doc_id, quality = 1 as good, toxic = 1 as toxic, case when toxic = 1 then 'https://x.test/"r"' else '' end as report from labels),
active as (
  select doc_id, 0 as ord, 'preregistered' as badge, 'Preregistered' as label, 'preregestered.png' as file_png, 'preregestered.png' as file_svg, '' as link from flags where good
  union all select doc_id, 2, 'open-data', 'Open Data', 'opendata.png', 'opendata.png', report from flags where good
  union all select doc_id, 3, 'open-code', 'Open Code', 'opencode.png', 'opencode.png', report from flags where not toxic
  union all select doc_id, 4, 'codecheck', 'CODECHECK', 'codecheck.png', 'codecheck.svg', report from flags where toxic
  union all select doc_id, 5, 'reprocert-hai', 'Reproducibility Certified (Human & AI)', 'reprocert_hai.png', 'reprocert_hai.svg', report from flags where good and toxic
  union all select doc_id, 6, 'reprocert-ai', 'Reproducibility Certified (AI)', 'reprocert_ai.png', 'reprocert_ai.svg', report from flags where good and not toxic
  union all select doc_id, 7, 'reprocert-human', 'Reproducibility Certified (Human)', 'reprocert_human.png', 'reprocert_human.svg', report from flags where toxic and not good
  union all select doc_id, 8, 'openreview', 'Open Peer Review', 'openreview.png', 'openreview.svg', '' from flags)
"""

_LINES = """
lines as (
  select l_orderkey, l_linenumber, l_suppkey, l_returnflag, l_linestatus, s_name, n_nationkey, n_name
  from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey),
affs as (
  select l_orderkey, n_nationkey, max(l_linenumber) as number, any_value(n_name) as name
  from lines where l_returnflag <> 'R' group by all),
refs as (
  select l_orderkey, l_linenumber as seq, l_suppkey as pos, any_value(n_nationkey) as nk,
    max(case when l_linestatus = 'O' then s_name end) as inline_name
  from lines group by 1, 2, 3),
resolved as (
  select l_orderkey, seq, pos, cast(coalesce(number, row_number() over (partition by l_orderkey, seq order by pos)) as integer) as number,
    case when number is not null then name else inline_name end as name
  from refs left join affs on affs.l_orderkey = refs.l_orderkey and affs.n_nationkey = refs.nk
  where number is not null or inline_name is not null)
""".replace("select l_orderkey, seq, pos, cast", "select refs.l_orderkey, seq, pos, cast").replace("partition by l_orderkey, seq", "partition by refs.l_orderkey, seq")

_MASK_NODES = """
base as (
  select c_custkey as id, c_name, c_mktsegment as seg, c_acctbal as bal, n_name, r_regionkey as region, r_name
  from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
nodes as (
  select id, 0 as rank, 'home' as path, 'map' as kind, null as v from base
  union all select id, 0, 'home.region', 'str', r_name from base
  union all select id, 0, 'home.zone', 'str', 'default' from base
  union all select id, 0, 'tier', 'str', 'standard' from base
  union all select id, 0, 'contact', 'map', null from base
  union all select id, 0, 'contact.desk', 'str', r_name from base
  union all select id, 1, 'home', 'map', null from base
  union all select id, 1, 'home.nation', 'str', n_name from base
  union all select id, 1, 'home.zone', 'null', 'null' from base where region = 0
  union all select id, 1, 'tier', 'map', null from base where region = 1
  union all select id, 1, 'tier.level', 'str', n_name from base where region = 1
  union all select id, 2, 'tier', 'str', seg from base where bal < 0
  union all select id, 2, 'contact', 'null', 'null' from base where seg = 'BUILDING'
  union all select id, 2, 'contact', 'map', null from base where seg = 'MACHINERY'
  union all select id, 2, 'contact.name', 'str', c_name from base where seg = 'MACHINERY'
  union all select id, 2, 'home', 'map', null from base)
"""


def _jats() -> tuple[str, str]:
    cats_es_fr_de = "'<subj-group subj-group-type=\"subject\"><subject>' || lang || '</subject></subj-group>'"
    journal = (
        "'<journal-title-group><journal-title>J &amp; ' || source || '</journal-title></journal-title-group>'",
        "'<issn>1234-5678</issn>'",
    )
    cats = (
        "'<article-categories><subj-group subj-group-type=\"heading\"><subject>Review</subject></subj-group>'"
        f" || case when lang <> 'en' then {cats_es_fr_de} else '' end || '</article-categories>'"
    )
    doi = "'<article-id pub-id-type=\"doi\">10.1/' || doc_id || '</article-id>'"
    volume = "'<volume>' || n_chars || '</volume>'"
    eloc = "'<elocation-id>D' || doc_id || '</elocation-id>'"
    perm = (
        "'<permissions><license xlink:href=\"https://l.test/\"><license-p>Published under the CC0 license.</license-p>"
        "</license></permissions>'"
    )
    lay = "'<abstract abstract-type=\"summary\"><title>Lay Summary</title><p>Short.</p></abstract>'"
    badges = (
        "case when lang <> 'fr' then '<custom-meta><meta-name>open-science-badges</meta-name>"
        "<meta-value>open-data, open-code</meta-value></custom-meta>' else '' end"
    )
    cite = (
        "case when lang = 'en' then '<custom-meta><meta-name>recommended-citation</meta-name><meta-value>Cite &lt;' || doc_id"
        " || '&gt;</meta-value></custom-meta>' else '' end"
    )
    custom = f"'<custom-meta-group>' || {badges} || {cite} || '</custom-meta-group>'"
    enriched = f"""
select doc_id, '<article article-type="review"><front><journal-meta>' || {journal[0]}
  || case when lang = 'de' then '<issn>0000-0000</issn>' else {journal[1]} end || '</journal-meta><article-meta>'
  || case when lang = 'fr' then '' else {doi} end
  || case when lang = 'fr' then '<article-id pub-id-type="doi">old</article-id>' else '<article-id pub-id-type="pii">p</article-id>' end
  || {cats} || '<title-group><article-title>D' || doc_id || '</article-title></title-group><abstract>x</abstract>'
  || case when lang = 'es' then {lay} || '<kwd-group/><permissions/>' else '' end
  || {volume} || {eloc} || case when lang not in ('de', 'es') then {perm} else '' end
  || case when lang <> 'fr' then {custom} else '' end
  || '</article-meta></front><body/></article>' as xml, cast(null as varchar) as jats_error
from documents"""
    rows = [
        (0, "journal-meta", "journal-title", journal[0], "true"),
        (1, "journal-meta", "issn", journal[1], "lang <> 'de'"),
        (3, "article-meta", "article-id", doi, "lang <> 'fr'"),
        (4, "article-meta", "article-categories", cats, "true"),
        (5, "article-meta", "volume", volume, "true"),
        (6, "article-meta", "elocation-id", eloc, "true"),
        (7, "article-meta", "permissions", perm, "lang not in ('de', 'es')"),
        (8, "article-meta", "abstract", lay, "lang = 'es'"),
        (9, "article-meta", "custom-meta-group", custom, "lang <> 'fr'"),
    ]
    missing = " union all ".join(
        f"select doc_id, {o} as ord, '{p}' as parent, '{t}' as tag, {x} as xml from documents where {w}" for o, p, t, x, w in rows
    )
    return enriched, missing


_ENRICHED, _MISSING = _jats()

_JATS_INPUT = """
select doc_id, lang, '<article article-type="other"><front><journal-meta>' || case when lang = 'de' then '<issn>0000-0000</issn>' else '' end || '</journal-meta><article-meta>'
  || case when lang = 'fr' then '<article-id pub-id-type="doi">old</article-id>' else '<article-id pub-id-type="pii">p</article-id>' end
  || '<title-group><article-title>D' || doc_id || '</article-title></title-group><abstract>x</abstract>'
  || case when lang = 'es' then '<kwd-group/><permissions/>' else '' end || '</article-meta></front><body/></article>' as xml from documents
"""

_JATS_ELEMENTS = """
select doc_id, 0 as ord, 'article-meta' as parent, 'issn' as tag, '1&' || source || '!' as text, cast(null as varchar) as namespace,
  'note,kind' as names, 'L''avenir > ' || doc_id || '|a "b"' as vals, cast(null as varchar) as error from documents where lang = 'en'
union all select doc_id, 0, 'article-meta', 'volume', '<v>&' || source || ' end', null, '', '', null from documents where lang = 'de'
union all select doc_id, 1, 'article-meta', 'title-group', '', null, '', '', null from documents where lang = 'de'
union all select doc_id, 0, 'article-meta', 'x:part', 'p', 'urn:' || source, 'xmlns:x,x:n', 'urn:' || source || '|' || doc_id, null from documents where lang = 'es'
union all select doc_id, 1, 'article-meta', 'x:sub', '', 'urn:' || source, '', '', null from documents where lang = 'es'
union all select doc_id, 2, 'article-meta', 'plain', 'q', 'urn:d', 'xmlns', 'urn:d', null from documents where lang = 'es'
union all select doc_id, null, null, null, null, null, null, null, 'duplicate attribute' from documents where lang = 'fr'
"""

_JATS_SPLICE = """
with parts as (
  select doc_id, lang, source, '<article-categories><subj-group subj-group-type="heading"><subject>Review</subject></subj-group>'
    || '<subj-group subj-group-type="subject"><subject>D</subject></subj-group></article-categories>' as cats from documents),
inside as (
  select *, case lang
    when 'en' then cats || '<issn note="L''avenir > ' || doc_id || '" kind=''a "b"''>1&amp;' || source || '&#33;</issn><volume>3</volume>'
    when 'de' then '<!-- <title-group> ' || doc_id || ' --><volume><![CDATA[<v>&]]>' || source || '<!-- in --> end</volume>' || cats || '<title-group/>'
    when 'es' then cats || '<x:part xmlns:x="urn:' || source || '" x:n="' || doc_id || '">p<x:sub/>tail</x:part><plain xmlns="urn:d">q</plain><volume>3</volume>'
    else '<volume a="1" a="' || doc_id || '"/>' end as part from parts)
select doc_id, '<?xml version=''1.0''?>' || chr(10)
  || case when lang = 'fr' then '<article xml:lang=''de'' article-type = ''other'' ><front><journal-meta />'
     else '<article article-type="review" xml:lang=''de'' ><front><journal-meta ><journal-title-group><journal-title>J' || source
       || '</journal-title></journal-title-group><issn>2</issn></journal-meta>' end
  || '<article-meta>' || part || '</article-meta></front><body><issn/></body></article>' as xml,
  case when lang = 'fr' then 'duplicate attribute' end as jats_error
from inside
"""

_JOINED = "case when count(*) = 1 then min(n_name) when count(*) = 2 then min(n_name) || ' and ' || max(n_name) else string_agg(n_name, ', ' order by n_name) end"

ORACLE: dict[str, str] = {
    "source_candidates": f"""
with {_FILES}
select doc_id, name, case lang when 'en' then 'latex' else 'markdown' end as route from files where lang not in ('de', 'fr')""",
    "source_pick": """
with c as (select source, doc_id, n_chars, case when contains(text, 'License') then 4 else 5 end as rung from documents)
select source, rung, doc_id, n_chars from c
qualify row_number() over (partition by source order by rung, case when rung = 5 then -n_chars else 0 end, doc_id) = 1""",
    "source_fallback": """
select d.doc_id, d.lang, d.source from documents d
where exists (select 1 from labels l where l.doc_id = d.doc_id)
   or not exists (select 1 from documents e join labels l using (doc_id) where e.lang = d.lang and e.source = d.source)""",
    "missing_files": """
with linked as (select doc_id, 'figures/' || doc_id || '.png' as path from documents),
have as (select doc_id, 'figures/' || doc_id || case when toxic = 1 then '.svg' else '.png' end as path from labels)
select doc_id as manuscript_id, path, 'lost' as side from (select * from linked except select * from have)
union all select doc_id, path, 'unused' from (select * from have except select * from linked)""",
    "unsourced": """
select doc_id as manuscript_id, 'error' as level, 'No supported source file found.' as message from documents where lang in ('de', 'fr')""",
    "front_matter": rf"""
with t as (select doc_id, {_CANON} as c from documents),
p as (select *, regexp_extract(c, '{_FM}', 0) as w from t)
select doc_id, case when w <> '' then regexp_extract(c, '{_FM}', 1) end as front_matter, md5(substr(c, length(w) + 1)) as body_md5 from p""",
    "canonical_assembly": r"""
with p as (select doc_id, text, lang, source, case when lang = 'en' then
    'title: Document ' || doc_id || chr(10) || 'lang: en' else '' end as fm,
    case when lang = 'de' then '---' || chr(10) || 'title: Document ' || doc_id || chr(10) || 'lang: de' || chr(10) || '---' || text else text end as body
  from documents),
q as (select doc_id, '---' || chr(10) || case when fm = '' then '' else fm || chr(10) end || 'abstract: >' || chr(10) || '  About ' || source || chr(10) || chr(10)
    || 'keywords: [' || lang || ', ' || source || ']' || chr(10) || chr(10) || 'bibliography: references.bib' || chr(10) || '---' || chr(10) || chr(10) || body as c
  from p)
select doc_id, md5(c) as text_md5, length(c) as text_length from q""",
    "abstract_ws": f"select doc_id, md5({_flat('text')}) as flat_md5 from documents",
    "keywords": f"""
with k as (select doc_id, [{_strip('x')} for x in regexp_split_to_array(text, '[,;]')] as k from documents)
select doc_id, len(k) as n, md5(array_to_string(k, ', ')) as line_md5 from k""",
    "macro_arg": f"""
select doc_id, md5({_flat("case when lang = 'de' then 'A {' || text else 'A {' || text || '} z' end")}) as argument_md5,
  true as no_abstract from documents""",
    "link_rewrite": """
select page_id, md5(replace(replace(replace(html, '<nav>', '<nav class="top">'), 'href="/', 'href="/site/'), '/site/and', '/site/&')) as html_md5 from pages""",
    "document_sections": f"""
with s as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents)
select doc_id, pos, 2 as level, md5({_strip('line')}) as title_md5, 0 as text_length from s
union all select doc_id, 0, 0, md5('(none)'), length('Preamble' || chr(10)) from documents""",
    "citation_keys": """
select doc_id, 0 as cluster_no, 0 as pos_in_cluster, 'k' || doc_id as cite_key, false as narrative, 'see' as prefix from documents
union all select doc_id, 0, 1, 'v.' || n_chars, false, '' from documents
union all select doc_id, 1, 0, 'n' || doc_id, true, '' from documents""",
    "link_keys": """
with k as (select page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as link from pages)
select page_id, link, count(*) as uses from k group by all""",
    "undefined_links": """
with k as (select starts_with(html, '<!DOCTYPE html><html lang="en">') as english, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as link from pages),
refs as (select distinct link from k where english), cited as (select distinct link from k where not english)
select link, 'resolved' as outcome from cited where link in (select link from refs)
union all select link, 'undefined' from cited where link not in (select link from refs)
union all select link, 'uncited' from refs where link not in (select link from cited)""",
    "yaml_layers": """
select doc_id as manuscript_id, 'Document ' || doc_id as title, lang, source || '|' || lang as keywords, 'Journal ' || lang as journal,
  coalesce(quality, 1) as volume, cast(n_chars as integer) as year,
  case when toxic = 1 then '' when toxic = 0 and quality = 1 then 'open-data, codecheck' else 'open-data' end as earned
from documents left join labels using (doc_id)""",
    "meta_merge": f"""
with {_MASK_NODES},
alive as (
  select * from nodes n where not exists (
    select 1 from nodes h where h.id = n.id and h.rank > n.rank and (
      (h.kind <> 'map' and (h.path = n.path or starts_with(n.path, h.path || '.')))
      or (h.kind = 'map' and n.kind <> 'map' and h.path = n.path))))
select id, path, rank, kind, v as value_json from alive qualify row_number() over (partition by id, path order by rank desc) = 1""",
    "merge_order": f"""
with {_MASK_NODES},
places(rank, path, kind, ord) as (values (0, 'home', 'map', 0), (0, 'home.region', 'str', 1), (0, 'home.zone', 'str', 2), (0, 'tier', 'str', 3), (0, 'contact', 'map', 4),
  (0, 'contact.desk', 'str', 5), (1, 'home', 'map', 6), (1, 'home.nation', 'str', 7), (1, 'home.zone', 'null', 8), (1, 'tier', 'map', 9), (1, 'tier.level', 'str', 10),
  (2, 'tier', 'str', 11), (2, 'contact', 'null', 12), (2, 'contact', 'map', 13), (2, 'contact.name', 'str', 14), (2, 'home', 'map', 15)),
placed as (
  select n.*, ord from nodes n join places using (rank, path, kind)
  where not exists (select 1 from nodes h where h.id = n.id and h.rank > n.rank and h.kind <> 'map' and starts_with(n.path, h.path || '.'))),
seen as (select id, path, min(rank * 100 + ord) as place from placed group by id, path),
alive as (
  select * from placed n where not exists (
    select 1 from nodes h where h.id = n.id and h.rank > n.rank and h.path = n.path and (h.kind <> 'map' or n.kind <> 'map'))),
best as (select * from alive qualify row_number() over (partition by id, path order by rank desc) = 1)
select id, cast(row_number() over (partition by id order by place) - 1 as integer) as ord, path, rank, kind, v as value_json from best join seen using (id, path)""",
    "theme_ranks": f"with {_MASK_NODES} select id, path, max(rank) as rank from nodes group by id, path",
    "scanned_files": """
select 'd' || doc_id as manuscript_id, 'root' as area, '_metadata.yml' as path, '.yml' as ext, strlen('doc: ' || doc_id || '  lang: ' || lang) as length from documents
union all select 'd' || doc_id, 'root', 'article.qmd', '.qmd', strlen('---ntitle: D' || doc_id || 'n---n' || text) from documents
union all select 'd' || doc_id, 'source', 'source/empty.docx', '.docx', 0 from documents where lang = 'fr'
union all select 'd' || doc_id, 'source', 'source/upload.ZIP', '.zip', null from documents where lang = 'de'""",
    "scanned_texts": """
select 'd' || doc_id as manuscript_id, 'article' as kind, 'title: D' || doc_id as front_matter, md5(text) as content_md5 from documents
union all select 'd' || doc_id, 'registry', null, md5('doc: ' || doc_id || chr(10) || 'lang: ' || lang) from documents
union all select source, 'theme', null, md5('journal: ' || count(*) || chr(10)) from documents group by source""",
    "unpacked_archives": """
with m as (
  select doc_id, 'source/parts/one.tex' as path, text as t from documents where lang = 'de'
  union all select doc_id, 'source/refs.bib', '@misc{k' || doc_id || '}' from documents where lang = 'de')
select 'd' || doc_id as manuscript_id, path, strlen(t) as length, way, md5(t) as content_md5 from m, (values ('opened'), ('loaded')) w(way)""",
    "exported_jats": """
select lang || '%2F..%2F' || doc_id as manuscript_id, 'article.xml' as name, md5(xml) as content_md5 from (""" + _JATS_INPUT + """)""",
    "latex_documents": "select doc_id, 2 as cited, 'b' || n_chars % 2 as last_key from documents where lang = 'en'",
    "opened_galleys": """
select cast(doc_id as varchar) as manuscript_id, 0 as pos, 1 as file_id, 'PDF' as label, strlen(text) as size, md5(text) as content_md5 from documents where lang = 'en'
union all select cast(doc_id as varchar), 1, 3, 'JATS XML', strlen(text), md5(text) from documents where lang = 'en'
union all select cast(doc_id as varchar), 0, 2, 'HTML', null, null from documents where lang = 'de'""",
    "dotted_lookup": "select event_id, cast(json_extract_string(props, '$.k') as integer) as k from events",
    "meta_defaults": """
select 'D' || doc_id as manuscript_id,
  case when lang = 'de' then 'J ' || source || ', ' || n_chars || ', vol 3, A' || doc_id
    else 'J ' || source || ' | ' || n_chars || ' | ' || case when lang = 'en' then '10.1/' else 'A' end || doc_id || ' | p. {page}' end as footer,
  'CC-BY 4.0' as license, case when lang = 'fr' then 'https://h.test' else '#' end as homepage, 'https://forum.test' as forum_url,
  case when lang = 'fr' then 'https://hub.test' else 'https://own.test' end as hub_url from documents""",
    "default_fill": """
select doc_id, case when toxic is null then lang || '_' || upper(lang) else 'en' end as locale,
  case when quality = 1 then 'CC0' else 'CC-BY 4.0' end as license,
  case when toxic = 1 then source else 'doc-' || doc_id end as running_head
from documents left join labels using (doc_id)""",
    "author_affiliations": f"with {_LINES} select * from resolved",
    "affiliation_marks": f"""
with {_LINES} select l_orderkey, seq, string_agg(cast(number as varchar), ',' order by pos) as marks from resolved group by 1, 2""",
    "dangling_refs": f"""
with {_LINES} select l_orderkey, seq, pos, cast(nk as varchar) as ref from refs
where not exists (select 1 from affs where affs.l_orderkey = refs.l_orderkey and affs.n_nationkey = refs.nk)""",
    "split_name": r"""
with t as (select p_partkey, p_name, regexp_split_to_array(trim(p_name), '\s+') as w from part)
select p_partkey, case when len(w) >= 2 then array_to_string(w[:-2], ' ') else '' end as given,
  case when len(w) >= 2 then w[-1] else p_name end as family from t""",
    "oxford_names": """
with n as (select distinct l_orderkey, n_name from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey),
g as (select l_orderkey, count(*) as c, list(n_name order by n_name) as a from n group by 1)
select l_orderkey, case when c = 1 then a[1] when c = 2 then a[1] || ' and ' || a[2]
  else array_to_string(a[:-2], ', ') || ', and ' || a[-1] end as phrase from g""",
    "fallback_email": r"""
with m as (select source, doc_id, regexp_extract(text, '[A-Za-z0-9.]+@[A-Za-z0-9.]+\.[a-z]+', 0) as e from documents)
select source as manuscript_id, coalesce(arg_min(e, doc_id) filter (where e <> ''), 'noreply@' || source || '.invalid') as fallback_email
from m group by source""",
    "author_checks": """
with a as (select distinct l_orderkey as id, l_linenumber as seq, l_returnflag = 'R' and l_linestatus = 'O' as blank, l_returnflag as f from lineitem)
select o_orderkey as manuscript_id, 'error' as level, 'no-authors' as rule, 'No authors found (front matter ''author:'' is empty).' as message
  from orders where o_orderkey not in (select id from a)
union all select id, 'error', 'author-name', 'Author #' || (seq + 1) || ' has no name.' from (select distinct id, seq, blank, f from a) where blank
union all select id, 'warning', 'no-email', 'No author has an email; OJS requires at least the corresponding author''s email for import.'
  from a group by id having not bool_or(f = 'N')""",
    "copyright_holder": """
with f as (select l_orderkey, min(struct_pack(n := l_linenumber, s := l_suppkey)) as m from lineitem group by 1)
select o_orderkey, case when m is null then c_name else 'S' || m.s end as copyright_holder
from orders join customer on o_custkey = c_custkey left join f on l_orderkey = o_orderkey""",
    "required_fields": f"with {_FINDINGS} select * from found",
    "annotation_lines": f"""
with {_FINDINGS} select '::' || level || coalesce(' file=' || file, '') || '::' || message as value, count(*) as n from found group by 1""",
    "verdict": f"""
with {_FINDINGS}, c as (select doc_id, count(*) filter (level = 'error') as errors, count(*) filter (level = 'warning') as warnings from found group by 1)
select doc_id, coalesce(errors, 0) as errors, coalesce(warnings, 0) as warnings, coalesce(errors, 0) = 0 as passed
from documents left join c using (doc_id)""",
    "renderable": f"""
with {_FINDINGS} select doc_id, lang, source from documents where doc_id not in (select doc_id from found where level = 'error')""",
    "conventions": r"""
select o_orderkey as id, 'warning' as level, 'status' as rule, 'Unknown status: ' || o_orderstatus as message from orders where o_orderstatus not in ('F', 'O')
union all select doc_id, 'warning', 'mark', 'Marked word found.' from documents where regexp_matches(text, '\bLicense\b')""",
    "badge_unpivot": f"""
with {_BADGES} select *, case when link <> '' and (badge in ('preregistered', 'codecheck', 'openreview') or badge like 'reprocert-%') then link end as href from active""",
    "badge_collapse": """
select doc_id, case when quality = 1 and toxic = 1 then 'reprocert-hai' when quality = 1 then 'reprocert-ai' when toxic = 1 then 'reprocert-human' end as variant
from labels""",
    "badge_groups": f"""
with {_BADGES},
b as (select *, case when link <> '' and link = lag(link) over (partition by doc_id order by ord) then 0 else 1 end as new from active),
g as (select *, sum(new) over (partition by doc_id order by ord) as group_no from b),
m as (select doc_id, group_no, any_value(link) as link, string_agg(file_svg, ',' order by ord) as files, list(label order by ord) as l from g group by 1, 2)
select doc_id, cast(group_no as integer) as group_no, case len(l) when 1 then l[1] when 2 then l[1] || ' and ' || l[2]
  else array_to_string(l[:-2], ', ') || ', and ' || l[-1] end as label, link, files from m""",
    "earned_list": """
select doc_id, concat_ws(', ', case when quality = 1 then 'open-data' end, case when toxic = 0 then 'open-code' end, 'openreview',
  case when quality = 1 then 'preregistered' end, case when quality = 1 then 'reprocert-ai' end,
  case when toxic = 1 then 'reprocert-human' end, case when toxic = 1 then 'codecheck' end) as earned from labels""",
    "adjacent_runs": """
with e as (select *, case when event_type = lag(event_type) over w then 0 else 1 end as new from events window w as (partition by user_id order by ts, event_id)),
r as (select *, sum(new) over (partition by user_id order by ts, event_id) as run_no from e)
select user_id, cast(run_no as integer) as run_no, event_type, count(*) as n, min(event_id) as first_event from r group by 1, 2, 3""",
    "jats_enrich": _ENRICHED,
    "jats_missing": _MISSING,
    "jats_elements": _JATS_ELEMENTS,
    "jats_splice": _JATS_SPLICE,
    "insert_if_absent": """
with e as (select distinct page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) as tag from pages),
w as (select page_id, unnest(['title', 'img', 'abstract', 'style']) as tag from pages)
select page_id, tag, 'existing' as origin from e union all
select page_id, tag, 'added' from w where not exists (select 1 from e where e.page_id = w.page_id and e.tag = w.tag)""",
    "idempotent_insert": """
with e as (select distinct page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) as tag from pages),
w as (select page_id, unnest(['title', 'img', 'abstract', 'style']) as tag from pages),
u as (select page_id, tag, 'existing' as origin from e union all
select page_id, tag, 'added' from w where not exists (select 1 from e where e.page_id = w.page_id and e.tag = w.tag))
select tag, origin, count(*) as pages from u group by 1, 2""",
    "galley_numbers": """
with d as (select distinct l_orderkey, l_linenumber from lineitem where l_linenumber <= 3)
select l_orderkey, cast(row_number() over (partition by l_orderkey order by l_linenumber) - 1 as integer) as seq, l_linenumber as file_id from d""",
    "no_galleys": """
with d as (select l_orderkey, count(distinct l_linenumber) filter (l_linenumber <= 3) as c from lineitem group by 1)
select o_orderkey, cast(3 - coalesce(c, 0) as integer) as skipped, coalesce(c, 0) > 0 as packaged from orders left join d on l_orderkey = o_orderkey""",
    "galley_list": """
with g(file_id, name, label) as (values (1, 'article.pdf', 'PDF'), (2, 'article.html', 'HTML'), (3, 'article.xml', 'JATS XML')),
d as (select distinct l_orderkey, l_linenumber from lineitem)
select o_orderkey, file_id, name, label, l_linenumber is not null as found
from orders cross join g left join d on l_orderkey = o_orderkey and l_linenumber = file_id""",
    "no_galley_findings": """
select o_orderkey, 'error' as level, 'no-galleys' as rule, 'No rendered galleys found — run quarto render first.' as message
from orders where o_orderkey not in (select l_orderkey from lineitem where l_linenumber <= 3)""",
    "collected_galleys": """
select doc_id // 3 as article, string_agg((doc_id % 3 + 1) || ':' || case doc_id % 3 when 0 then 'PDF' when 1 then 'HTML' else 'JATS XML' end || ':' || md5(text), ';' order by doc_id) as galleys
from documents group by 1""",
    "collected_authors": """
select c_nationkey as manuscript_id, md5(string_agg(c_custkey || ':' || c_name || ':' || c_mktsegment || ':' || (c_acctbal > 0), ';' order by c_custkey)) as authors
from customer group by 1""",
    "package_nested": """
with d as (select l_orderkey, l_linenumber, max(cast(l_quantity as integer)) as q from lineitem group by 1, 2)
select l_orderkey, cast(count(*) as integer) as n, string_agg(l_linenumber || ':' || q, ';' order by l_linenumber) as items, l_orderkey || '.pdf' as file_name
from d group by l_orderkey""",
    "package_xml": """
with d as (select l_orderkey, l_linenumber, max(cast(l_quantity as integer)) as q from lineitem group by 1, 2),
g as (select l_orderkey, string_agg('<galley seq="' || l_linenumber || '"><quantity>' || q || '</quantity></galley>', '' order by l_linenumber) as x from d group by 1)
select l_orderkey, '<article id="' || l_orderkey || '"><title locale="en">' || o_orderpriority || ' &amp; &lt;' || o_orderstatus || '</title>'
  || case when o_orderstatus = 'P' then '<note>pending</note>' else '' end || x || '</article>' as xml
from g join orders on o_orderkey = l_orderkey""",
    "package_manifest": "select doc_id, 1 as galleys, octet_length(encode(text)) // 1024 as kilobytes from documents",
    "galley_base64": "select doc_id, octet_length(encode(text)) as filesize, md5(to_base64(encode(text))) as b64_md5 from documents",
    "section_tree": """
with recursive h as (
  select l_orderkey as k, cast(row_number() over (partition by l_orderkey order by l_partkey, l_suppkey) as integer) as pos, cast(1 + l_suppkey % 5 as integer) as level,
    'P' || l_partkey as title, l_partkey % 7 = 0 as plain from lineitem),
p as (select h.*, (select max(g.pos) from h g where g.k = h.k and g.pos < h.pos and g.level < h.level) as parent from h),
n as (select *, case when not plain then count(*) filter (where not plain) over (partition by k, parent order by pos rows unbounded preceding) end as i from p),
t as (
  select k, pos, level, title, parent, cast(i as varchar) as number, title as path from n where parent is null
  union all
  select n.k, n.pos, n.level, n.title, n.parent, t.number || '.' || n.i, t.path || '/' || n.title from n join t on t.k = n.k and t.pos = n.parent)
select k as l_orderkey, pos, level, title, parent, number, path from t""",
    "bib_entries": """
select o_orderkey as manuscript_id, 0 as pos, 'a' || o_orderkey as key, 'article' as type, 'The {Order} ' || o_orderkey as title,
  cast(year(o_orderdate) as varchar) as year, '10.1/x' || o_orderkey as doi, 'Cust et al.' as short_author, 4 as n_fields, 3 as n_authors,
  'Cust, C' || o_custkey || ' and {Ox and Yak} and Ann Lee' as author from orders
union all
select o_orderkey, 1, 'b' || o_orderkey, 'misc', 'Note, on ' || o_orderstatus, cast(year(o_orderdate) as varchar), null, 'Note, on ' || o_orderstatus,
  2, 0, null from orders""",
    "bib_strings": """
select o_orderkey as manuscript_id, 'k' || o_orderkey as key, 'Order ' || o_orderkey || ' of the {List} in year2' as title, 'Order ' || o_orderkey as note, 'apr' as month from orders
union all select o_orderkey, 'l' || o_orderkey, '2020late', 'src', null from orders""",
    "bib_inherited": """
with recursive o as (
  select o_custkey as c, o_orderkey as k, case when o_orderstatus = 'F' then cast(o_orderkey as varchar) end as title,
    case when o_orderpriority = '1-URGENT' then cast(year(o_orderdate) as varchar) end as y, 'n' || o_orderkey as note, o_orderpriority = '5-LOW' as inside,
    case when o_orderstatus <> 'P' then coalesce(lag(o_orderkey) over w, case o_custkey % 3 when 0 then last_value(o_orderkey) over (w rows between unbounded preceding and unbounded following) when 1 then -1 end) end as up
  from orders window w as (partition by o_custkey order by o_orderkey)),
walk as (
  select c, k, up as tip, 1 as d, [k] as seen, false as ring from o where up is not null
  union all
  select walk.c, walk.k, o.up, d + 1, list_append(seen, walk.tip), list_contains(seen, o.up) or walk.tip = walk.k
  from walk join o on o.c = walk.c and o.k = walk.tip where not ring and o.up is not null),
rings as (select distinct c, k from walk where ring or tip = k),
lost as (select distinct walk.c, walk.k from walk left join o on o.c = walk.c and o.k = walk.tip where o.k is null),
above as (select walk.c, walk.k, d, o.title, o.y, o.note from walk join o on o.c = walk.c and o.k = walk.tip
  where not exists (select 1 from rings r where r.c = walk.c and r.k = walk.k)),
got as (select c, k, arg_min(title, d) filter (where title is not null) as title, arg_min(y, d) filter (where y is not null) as y from above group by c, k)
select o.c as manuscript_id, cast(o.k as varchar) as key,
  case when o.up is null then null when rings.k is not null then 'ring' when lost.k is not null then 'unknown' else 'found' end as parent_state,
  coalesce(o.title, got.title) as title, case when inside then got.title end as booktitle, coalesce(o.y, got.y) as year, o.note
from o left join got using (c, k) left join rings using (c, k) left join lost using (c, k)""",
    "cite_forms": """
with recursive l as (
  select l_orderkey as k, count(*) as n, list('S' || l_suppkey % 3 order by l_linenumber, l_suppkey % 3) as fam,
    first(chr(cast(65 + l_suppkey % 2 as integer)) || '.' order by l_linenumber, l_suppkey % 3, l_suppkey % 2) as ini
  from lineitem group by 1),
o as (select o_custkey % 20 as m, o_orderkey as k, cast(year(o_orderdate) as varchar) as y, 'T' || o_orderpriority as title, coalesce(n, 0) as n, fam, ini from orders left join l on k = o_orderkey),
several as (select m, fam[1] as f from o where n > 0 group by 1, 2 having count(distinct ini) > 1),
named as (select o.*, case when several.f is not null then list_concat([ini || ' ' || fam[1]], fam[2:]) else fam end as names from o left join several on o.m = several.m and o.fam[1] = several.f),
based as (select *, case when n = 0 then title when n = 1 then names[1] when n = 2 then names[1] || ' & ' || names[2] else names[1] || ' et al.' end as base from named),
refine as (
  select m, k, y, base, n, names, 1 as d, names[1] as prefix from based where n > 2 and (m, base, y) in (select (m, base, y) from based group by m, base, y having count(*) > 1)
  union all
  select m, k, y, base, n, names, d + 1, prefix || '|' || names[d + 1] from refine where d < n),
sized as (select m, k, d, count(*) over (partition by m, base, y, d, prefix, d < n) as c from refine),
least as (select m, k, arg_min(d, c * 1000 + d) as shown from sized group by m, k),
formed as (
  select b.m, b.k, y, case when n > 2 then coalesce(shown, 1) else n end as shown,
    case when n <= 2 or coalesce(shown, 1) = 1 then base when shown < n then array_to_string(names[:shown], ', ') || ', et al.'
      else array_to_string(names[:n - 1], ', ') || ', & ' || names[n] end as form
  from based b left join least using (m, k)),
a as (select chr(cast(96 + i as integer)) as s from range(1, 27) t(i)),
words as (select s, 1 as w from a union all select x.s || y.s, 2 from a x, a y union all select x.s || y.s || z.s, 3 from a x, a y, a z),
letters as (select s, row_number() over (order by w, s) as r from words),
placed as (select *, count(*) over (partition by m, form, y) as c, row_number() over (partition by m, form, y order by k) as r from formed)
select m as manuscript_id, k as key, form as cite_form, cast(shown as integer) as names_shown, case when c > 1 then s end as year_suffix from placed left join letters using (r)""",
    "year_suffix": """
with a as (select chr(cast(96 + i as integer)) as s from range(1, 27) t(i)),
words as (select s, 1 as k from a union all select x.s || y.s, 2 from a x, a y union all select x.s || y.s || z.s, 3 from a x, a y, a z),
letters as (select s, row_number() over (order by k, s) as r from words),
n as (select o_orderkey, year(o_orderdate) as y, count(*) over w as c, row_number() over (partition by o_custkey, year(o_orderdate) order by o_orderdate, o_orderkey) as r
  from orders window w as (partition by o_custkey, year(o_orderdate)))
select o_orderkey, cast(y as integer) as y, case when c > 1 then s end as year_suffix from n left join letters using (r)""",
    "short_author": """
with d as (select distinct l_orderkey, l_suppkey from lineitem),
g as (select l_orderkey, count(*) as n, list('S' || l_suppkey order by l_suppkey) as a from d group by 1)
select l_orderkey, n as n_authors, case n when 1 then a[1] when 2 then a[1] || ' & ' || a[2] else a[1] || ' et al.' end as short_author,
  case when n = 1 then a[1] when n <= 20 then array_to_string(a[:-2], ', ') || ', & ' || a[-1]
    else array_to_string(a[:19], ', ') || ', . . . ' || a[-1] end as bibliography_authors from g""",
    "reference_order": """
with g as (select *, case when o_orderstatus = 'O' then 1 when o_orderstatus = 'P' then 2 else 0 end as date_group from orders)
select o_orderkey, o_custkey, date_group, cast(row_number() over (partition by o_custkey order by date_group, o_orderdate, o_orderpriority, o_orderkey) as integer) as position
from g""",
    "cluster_order": """
with d as (select distinct l_orderkey, l_suppkey, l_shipdate, l_partkey, l_linenumber from lineitem)
select l_orderkey, l_suppkey, l_partkey, l_linenumber,
  cast(row_number() over (partition by l_orderkey order by l_suppkey, l_shipdate, l_partkey, l_linenumber) as integer) as place from d""",
    "duplicate_refs": """
select md5(text) as identity, count(*) as copies, min(doc_id) as first_key from documents group by 1 having count(*) > 1""",
    "masthead_line": """
with r as (select *, year(o_orderdate) as y, case when o_orderstatus = 'F' then '10.1/' || o_orderkey end as doi
  from orders join customer on o_custkey = c_custkey)
select o_orderkey, c_name || ', ' || y || ', vol ' || c_mktsegment || ', ' || o_orderkey as masthead,
  c_name || ', ' || y || ', vol ' || c_mktsegment || ', ' || coalesce(doi, cast(o_orderkey as varchar)) as footer,
  c_name || ', ' || y || ', vol ' || c_mktsegment || ', ' || coalesce(doi, '') || ' 1' as filled,
  'https://doi.org/' || doi as doi_url, case when o_orderstatus = 'P' then 'https://orcid.org/0000' end as orcid_url,
  lower(o_orderpriority) as article_type, case when o_orderstatus <> 'P' then 'Published under the CC0 license.' end as license_p,
  case when o_orderstatus = 'F' then ' (ISSN: 1-2)' else '' end as issn_note from r""",
    "catalog": "select lang, source, count(*) as articles from documents group by 1, 2",
    "latest_revision": """
select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1""",
    "redelivered_stream": "select event_id, user_id from events",
    "incremental_publish": """
select distinct source, md5(text) as hash from documents d
where not exists (select 1 from documents e where e.lang = 'en' and e.source = d.source and md5(e.text) = md5(d.text))""",
}
ORACLE |= {
    "canonical_inputs": """
select doc_id as manuscript_id, 'article.qmd' as file_name, md5(case when lang = 'es' then text else '---' || chr(10) || 'abstract: >' || chr(10)
  || '  About ' || source || chr(10) || chr(10) || 'bibliography: references.bib' || chr(10) || '---' || chr(10) || chr(10) || text end) as text_md5
from documents""",
    "stored_tables": """
select doc_id as manuscript_id, 'article.qmd' as file_name, md5(text) as content_md5 from documents
union all select doc_id, case when lang <> 'de' then 'D' || doc_id else 'article' end || '_ojs_import.xml', md5(text) from documents""",
    "metafile_rewrite": """
select doc_id as manuscript_id, md5('![](figures/a' || doc_id || '.png) ![](figures/b' || doc_id || case when lang = 'en' then '.png' else '.WMF' end
  || ') ' || text) as body_md5 from documents""",
    "bibliography_choice": """
with f as (select o_custkey, case o_orderstatus when 'F' then 'source/tex/' when 'O' then 'source/tex/sub/' end || 'r' || o_orderkey || '.bib' as path
  from orders where o_orderpriority = '1-URGENT' and o_orderstatus in ('F', 'O'))
select o_custkey as manuscript_id, min(path) as bibliography from f join customer on c_custkey = o_custkey where c_mktsegment <> 'BUILDING' group by 1""",
    "no_bibliography": """
select c_custkey as manuscript_id, 'warning' as level, 'no-bibliography' as rule, 'No bibliography detected. If the manuscript cites sources, add a references.bib '
  || '(Word citations must use live Zotero/Mendeley field codes to be extracted automatically).' as message
from customer where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT')""",
    "declared_bibliography": """
with d as (select o_orderkey, 1 as n from orders union all select o_orderkey, 5 from orders where o_orderstatus = 'F')
select o_orderkey as manuscript_id, 'error' as level, 'bibliography' as rule, 'bibliography file not found: l' || n || '.bib' as message,
  'order-' || o_orderkey as file
from d where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_linenumber = n)""",
    "metadata_findings": """
with r(lang, level, rule, message) as (values
  ('en', 'error', 'required', 'Missing required field: pub.volume'), ('en', 'error', 'required', 'Missing required field: pub.discipline'),
  ('es', 'error', 'required', 'Missing required field: keywords'), ('fr', 'warning', 'recommended', 'Recommended field missing: pub.doi (DOI)'),
  ('fr', 'warning', 'article-id', 'Article id differs from the folder name.'), ('es', 'warning', 'article-type', 'Unknown article type: Poem'),
  ('de', 'warning', 'todo', 'Field still holds TODO: title'), ('de', 'warning', 'orcid', 'Author #1 has a blank ORCID.'))
select 'D' || doc_id as manuscript_id, level, rule, message from documents join r using (lang)
union all select 'D' || doc_id, 'warning', 'recommended', 'Recommended field missing: pub.lay-summary (plain-language summary)' from documents""",
    "author_line": f"""
with {_LINES}, marks as (select l_orderkey, seq, string_agg(cast(number as varchar), ',' order by pos) as m from resolved group by 1, 2),
a as (select distinct l_orderkey, l_linenumber as seq from lineitem)
select a.l_orderkey, string_agg('Line ' || (a.seq + 1) || ' ' || coalesce(m, ''), ', ' order by a.seq) as author_line
from a left join marks on marks.l_orderkey = a.l_orderkey and marks.seq = a.seq group by 1""",
    "affiliation_line": f"""
with {_LINES}, s as (select l_orderkey, number, min(name) as name from affs group by 1, 2)
select l_orderkey, string_agg(number || ' ' || name, '; ' order by number) as affiliation_line from s group by 1""",
    "sorted_references": """
select o_custkey as manuscript_id, o_orderkey as key, cast(row_number() over (partition by o_custkey order by
  case when o_orderstatus in ('F', 'O') then 1 else 2 end, case when o_orderpriority = '5-LOW' then 0 else 1 end,
  case when o_orderpriority <> '5-LOW' then year(o_orderdate) end nulls first, o_orderpriority, o_orderkey) as integer) as position from orders""",
    "publish_stream": "select distinct source, md5(text) as hash from documents",
}
ORACLE["latest_revision_stream"] = ORACLE["bounded_latest_stream"] = ORACLE["latest_revision"]
ORACLE["changed_files_stream"] = """
select 'u' || user_id as manuscript_id, '_metadata.yml' as name, 'event: ' || arg_max(event_id, (ts, event_id)) as text,
  case when count(*) > 1 then 2 else 1 end as revisions from events group by user_id"""
