"""SQL that says what cleaning, parsing, packing and cutting of Markdown do, as folds over lists of lines and blocks.

Each function gives the text of one or more CTEs over the one before; ``source`` is a table of (id, text), texts not null.
"""

from __future__ import annotations

from docloom.profiles import HEADING, LIST_ITEM, NUMBERED, RE2_SPACE, SPECIAL_LINE, ZH, any_of, re2

_NL = "chr(10)"
_TABLE, _IMAGE = "chr(57344)", "chr(57345)"


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '\\A[{RE2_SPACE}]+|[{RE2_SPACE}]+\\z', '', 'g')"


def rstrip(x: str) -> str:
    return f"regexp_replace({x}, '[{RE2_SPACE}]+\\z', '', 'g')"


PAGE = quote(re2(any_of([p.replace("$", r"\z") for p in ZH.page_patterns])))
BOILER = quote(any_of(ZH.boilerplate))
STOPS = ZH.terminators


def sentences(x: str) -> str:
    cut = f"list_filter(list_transform(regexp_extract_all(l, '[^{STOPS}]*[{STOPS}]|[^{STOPS}]+'), lambda s: {strip('s')}), lambda s: s <> '')"
    return f"flatten(list_transform(string_split({x}, {_NL}), lambda l: CASE WHEN {strip('l')} = '' THEN [l] ELSE {cut} END))"


def class_case(x: str) -> str:
    whens = " ".join(f"WHEN regexp_matches({x}, {quote(re2(any_of(ps)))}) THEN {quote(name)}" for name, ps in ZH.classes)
    return f"CASE WHEN {x} IS NULL THEN NULL {whens} ELSE {quote(ZH.other)} END"


def triggers(x: str) -> str:
    whens = " ".join(f"WHEN regexp_matches({x}, {quote(re2(p))}) THEN regexp_extract_all({x}, {quote(re2(p))})" for _, ps in ZH.classes for p in ps)
    return f"CASE {whens} ELSE []::VARCHAR[] END"


def squeezed(t: str) -> str:
    out = f"array_to_string(list_transform(string_split({t}, {_NL}), lambda x: {rstrip('x')}), {_NL})"
    for run, kept in ((r"\n{4,}", f"{_NL} || {_NL} || {_NL}"), (r"\A\n{3,}", f"{_NL} || {_NL}"), (r"\n{3,}\z", f"{_NL} || {_NL}"), (r"\A\n{2,}\z", _NL)):
        out = f"regexp_replace({out}, '{run}', {kept}, 'g')"
    return out


def cleaned(source: str) -> str:
    """cleaned(id, text): without page lines, headers and footers, with broken lines joined; tables and images untouched."""
    put = lambda t, mark, kept: f"array_to_string(list_transform(range(1, len(string_split({t}, {mark})) + 1), lambda i: string_split({t}, {mark})[i] || coalesce({kept}[i], '')), '')"
    return f"""
    k0 AS (SELECT id, replace(replace(text, {_TABLE}, '�'), {_IMAGE}, '�') AS t FROM {source}),
    k1 AS (SELECT id, regexp_extract_all(t, '(?s)<table.*?</table>') AS tables, regexp_replace(t, '(?s)<table.*?</table>', {_TABLE}, 'g') AS t FROM k0),
    k2 AS (SELECT id, tables, regexp_extract_all(t, '!\\[.*?\\]\\(.*?\\)') AS images, regexp_replace(t, '!\\[.*?\\]\\(.*?\\)', {_IMAGE}, 'g') AS t FROM k1),
    k3 AS (SELECT id, tables, images, list_filter(string_split(t, {_NL}), lambda x: NOT (regexp_matches(x, {PAGE}, 'i') AND length({strip('x')}) <= 10)) AS ls FROM k2),
    k4 AS (SELECT *, CASE WHEN len(ls) < 10 THEN []::VARCHAR[] ELSE list_filter(list_distinct(ls[1 : least(5, len(ls) // 10)] || ls[len(ls) - least(5, len(ls) // 10) + 1 : len(ls)]),
      lambda x: len(list_filter(ls, lambda y: y = x)) >= 2 AND length({strip('x')}) > 0 AND length({strip('x')}) >= CASE WHEN len(list_filter(ls, lambda y: y = x)) > 2 THEN 10 ELSE 20 END) END AS gone FROM k3),
    k5 AS (SELECT id, tables, images, ls, list_transform(ls, lambda x: {strip('x')}) AS st FROM (SELECT * REPLACE (list_filter(ls, lambda x: NOT list_contains(gone, x)) AS ls) FROM k4)),
    k6 AS (SELECT *, list_transform(range(1, len(ls) + 1), lambda i: st[i] <> '' AND NOT starts_with(st[i], '#') AND NOT regexp_matches(st[i], '[{STOPS}]\\z') AND NOT st[i][1] IN ({_TABLE}, {_IMAGE}) AND NOT st[i][-1] IN ({_TABLE}, {_IMAGE})
      AND coalesce(st[i + 1], '') <> '' AND NOT regexp_matches(st[i + 1], {quote(re2(SPECIAL_LINE))}) AND NOT st[i + 1][1] IN ({_TABLE}, {_IMAGE})) AS can FROM k5),
    k7 AS (SELECT id, tables, images, array_to_string(list_reduce(range(1, len(ls) + 1), lambda a, i: CASE WHEN a.taken THEN {{'o': a.o, 'taken': false}} WHEN can[i] THEN {{'o': a.o || [st[i] || ' ' || st[i + 1]], 'taken': true}} ELSE {{'o': a.o || [ls[i]], 'taken': false}} END, {{'o': []::VARCHAR[], 'taken': false}}).o, {_NL}) AS t FROM k6),
    k8 AS (SELECT id, tables, {put('t', _IMAGE, 'images')} AS t FROM k7),
    cleaned AS (SELECT id, {put('t', _TABLE, 'tables')} AS text FROM k8)"""


def blocks(source: str) -> str:
    """blocks(id, block_no, kind, content, path, level, title, line): the blocks of each text."""
    return f"""
    b0 AS (SELECT id, string_split(text, {_NL}) AS ls FROM {source}),
    b1 AS (SELECT id, ls, list_transform(ls, lambda r: {strip('r')}) AS st FROM b0),
    b2 AS (SELECT id, ls, st, list_transform(st, lambda s: CASE WHEN s = '' THEN 'blank' WHEN regexp_matches(s, {quote(re2(HEADING))}) THEN 'heading' WHEN starts_with(s, '<table') THEN 'table' WHEN regexp_matches(s, {quote(re2(LIST_ITEM))}) THEN 'list' ELSE 'text' END) AS ks FROM b1),
    b3 AS (SELECT id, ls, st, ks, list_reduce(range(1, len(ls) + 1), lambda a, i: CASE
        WHEN a.mode = 'table' OR (a.mode = 'list' AND (ks[i] IN ('blank', 'list') OR starts_with(ls[i], '  ') OR starts_with(ls[i], chr(9)))) OR (a.mode = 'paragraph' AND ks[i] = 'text')
          THEN {{'mode': CASE WHEN a.mode = 'table' AND contains(ls[i], '</table>') THEN '' ELSE a.mode END, 'n': a.n, 'o': a.o || [a.n]}}
        WHEN ks[i] = 'blank' THEN {{'mode': '', 'n': a.n, 'o': a.o || [0]}}
        ELSE {{'mode': CASE ks[i] WHEN 'heading' THEN '' WHEN 'table' THEN CASE WHEN contains(ls[i], '</table>') THEN '' ELSE 'table' END WHEN 'text' THEN 'paragraph' ELSE ks[i] END, 'n': a.n + 1, 'o': a.o || [a.n + 1]}} END,
        {{'mode': '', 'n': 0, 'o': []::INTEGER[]}}).o AS bs FROM b2),
    b4 AS (SELECT id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS l, unnest(ks) AS k, unnest(bs) AS b, unnest(st) AS s FROM b3),
    b5 AS (SELECT id, b, min(i) AS first, CASE arg_min(k, i) WHEN 'text' THEN 'paragraph' ELSE arg_min(k, i) END AS kind, string_agg(l, {_NL} ORDER BY i) AS content, arg_min(s, i) AS s FROM b4 WHERE b > 0 GROUP BY id, b),
    b6 AS (SELECT id, list({{'b': b, 'first': first, 'kind': kind, 'content': content, 'lv': length(regexp_extract(s, {quote(re2(HEADING))}, 1)), 'title': CASE WHEN kind = 'heading' THEN regexp_extract(s, {quote(re2(HEADING))}, 2) END}} ORDER BY b) AS bl FROM b5 GROUP BY id),
    b7 AS (SELECT id, bl, list_reduce(bl, lambda a, x: CASE WHEN x.kind = 'heading' THEN {{'level': x.lv, 'path': a.path[1 : x.lv - 1] || [x.title], 'o': a.o || [{{'level': x.lv, 'path': a.path[1 : x.lv - 1] || [x.title]}}]}} ELSE {{'level': a.level, 'path': a.path, 'o': a.o || [{{'level': a.level, 'path': a.path}}]}} END,
        {{'level': 0::BIGINT, 'path': []::VARCHAR[], 'o': []::STRUCT(level BIGINT, path VARCHAR[])[]}}).o AS ps FROM b6),
    blocks AS (SELECT id, x.b - 1 AS block_no, x.kind AS kind, x.content AS content, p.path AS path, p.level AS level, x.title AS title, x.first - 1 AS line FROM (SELECT id, unnest(bl) AS x, unnest(ps) AS p FROM b7))"""


def atoms(source: str) -> str:
    """atoms(id, atom_no, text, kind, words) of texts, by (id, text); ids may be structs."""
    return f"""
    a1 AS (SELECT id, string_split_regex(text, '[。；\\n]') AS fs, list_append(regexp_extract_all(text, '[。；\\n]'), '') AS ds FROM {source}),
    a2 AS (SELECT id, generate_subscripts(fs, 1) AS pos, unnest(fs) AS f, unnest(ds) AS d FROM a1),
    a3 AS (SELECT *, {class_case('f')} AS kind, {triggers('f')} AS hits FROM a2),
    a4 AS (SELECT *, lag(kind) OVER (PARTITION BY id ORDER BY pos) AS prev FROM a3),
    a5 AS (SELECT *, sum(CASE WHEN prev IS NOT NULL AND prev <> '其他' AND prev <> kind THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY pos) AS grp,
      CASE WHEN kind = '其他' THEN []::VARCHAR[] WHEN prev IS NULL OR prev = '其他' THEN list_concat(hits, hits) ELSE hits END AS words FROM a4),
    a6 AS (SELECT id, grp, string_agg(f || d, '' ORDER BY pos) AS t, arg_max(kind, pos) AS kind, flatten(list(words ORDER BY pos)) AS words FROM a5 GROUP BY id, grp),
    a7 AS (SELECT id, grp, {strip('t')} AS text, kind, words FROM a6),
    atoms AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY grp) - 1 AS atom_no, text, kind, words FROM a7 WHERE text <> ''
      UNION ALL SELECT id, 0, text, '其他', []::VARCHAR[] FROM {source} WHERE {strip('text')} = '')"""


def _by_number(t: str) -> str:
    """The parts between the numbers of list points, each with whether it stands before the second number."""
    starts = f"list_reduce(regexp_extract_all({t}, {quote(re2(NUMBERED))}), lambda a, m: {{'at': a.at + instr(substring({t}, a.at + 1), m) - 1 + length(m), 'o': a.o || [a.at + instr(substring({t}, a.at + 1), m) - 1]}}, {{'at': 0::BIGINT, 'o': []::BIGINT[]}}).o"
    return starts


def pieces(source: str, longest: int) -> str:
    """pieces(id, piece_no, text, keeps): texts of ``source`` (id, text) cut where longer than ``longest``; ``keeps`` says that a piece keeps trigger words."""

    def dotted(t: str, keeps: str) -> str:
        bits = f"string_split_regex({t}, '[，。；：][{RE2_SPACE}]*')"
        packed = f"list_reduce({bits}, lambda a, x: CASE WHEN length(a[-1]) + length(x) > {longest} THEN a || [x] ELSE a[1:-2] || [a[-1] || x] END, [''])"
        kept = f"list_filter(list_transform(range(1, len({packed}) + 1), lambda i: {{'t': {strip(f'({packed})[i]')}, 'inner': i < len({packed})}}), lambda p: p.t <> '')"
        marked = f"list_transform(range(1, len({kept}) + 1), lambda i: {{'t': ({kept})[i].t, 'keeps': {keeps} AND ({kept})[i].inner AND i = 1}})"
        fixed = f"list_transform(range(0, length({t}), {longest}), lambda i: {{'t': substring({t}, i + 1, {longest}), 'keeps': {keeps} AND i = 0}})"
        whole = f"[{{'t': {t}, 'keeps': {keeps}}}]"
        return f"CASE WHEN length({t}) <= {longest} THEN {whole} WHEN len({bits}) > 1 THEN CASE WHEN len({kept}) = 0 THEN {whole} ELSE {marked} END ELSE {fixed} END"

    return f"""
    p1 AS (SELECT id, text, {_by_number('text')} AS ns FROM {source}),
    p2 AS (SELECT id, text, ns, list_sort(list_distinct([0::BIGINT] || ns || [length(text)])) AS es FROM p1),
    p3 AS (SELECT id, text, ns, list_filter(list_transform(range(1, len(es)), lambda i: {{'t': {strip('substring(text, es[i] + 1, es[i + 1] - es[i])')}, 'keeps': es[i] <= ns[1]}}), lambda p: p.t <> '') AS parts FROM p2),
    p4 AS (SELECT id, unnest(CASE WHEN length(text) > {longest} AND len(ns) > 0 AND ns <> [0] AND len(parts) > 1 THEN list_transform(range(1, len(parts) + 1), lambda i: {{'no': i, 't': parts[i].t, 'keeps': parts[i].keeps}}) ELSE [{{'no': 1, 't': text, 'keeps': true}}] END) AS x FROM p3),
    p5 AS (SELECT id, x.no AS no, {dotted('x.t', 'x.keeps')} AS ys FROM p4),
    p6 AS (SELECT id, no, generate_subscripts(ys, 1) AS sub, unnest(ys) AS y FROM p5),
    pieces AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY no, sub) - 1 AS piece_no, y.t AS text, y.keeps AS keeps FROM p6)"""


def chunks(source: str, target: int = 800, largest: int = 1500, least: int = 200, repeat: int = 3) -> str:
    """The chunks of texts with all their metadata; arrays come out joined."""
    close = "CASE WHEN len(a.open) > 0 THEN [{'ix': a.open, 'run': NULL::VARCHAR}] ELSE []::STRUCT(ix BIGINT[], run VARCHAR)[] END"
    runs = f"list_reduce(regexp_extract_all(cs[i], '[^。！？\\n]*[。！？\\n]|[^。！？\\n]+'), lambda r, s: CASE WHEN length(r[-1]) > 0 AND length(r[-1]) + length(s) > {largest} THEN r || [s] ELSE r[1:-2] || [r[-1] || s] END, [''])"
    terms = ", ".join(f"({quote(s)}, {quote(v)})" for v, s in {v: s for s, vs in ZH.terms.items() for v in vs}.items())
    core = " OR ".join(f"contains(array_to_string(section_path, ' '), {quote(w)})" for w in ZH.core_sections)
    return f"""WITH lines AS (SELECT id, regexp_replace(text, '\\r\\n?', {_NL}, 'g') AS text FROM {source}),{cleaned('lines')},
    tidy AS (SELECT id, {squeezed('text')} AS text FROM cleaned),{blocks('tidy')},
    said AS (SELECT id, {strip('s')} AS key FROM (SELECT id, unnest({sentences('content')}) AS s FROM blocks WHERE kind <> 'heading')),
    again AS (SELECT id, list(key) AS keys FROM (SELECT id, key FROM said WHERE key <> '' GROUP BY ALL HAVING count(*) >= {repeat}) GROUP BY id),
    g1 AS (SELECT id, list(kind ORDER BY block_no) AS kinds, list(content ORDER BY block_no) AS cs, list(path ORDER BY block_no) AS paths, list(level ORDER BY block_no) AS levels, list(line ORDER BY block_no) AS firsts FROM blocks GROUP BY id),
    g2 AS (SELECT *, list_reduce(range(1, len(cs) + 1), lambda a, i: CASE
        WHEN kinds[i] = 'heading' THEN {{'open': []::BIGINT[], 'size': 0::BIGINT, 'o': a.o || {close}}}
        WHEN kinds[i] = 'table' OR (length(cs[i]) > {largest} AND kinds[i] <> 'paragraph') THEN {{'open': []::BIGINT[], 'size': 0::BIGINT, 'o': a.o || {close} || [{{'ix': [i], 'run': NULL::VARCHAR}}]}}
        WHEN length(cs[i]) > {largest} THEN {{'open': []::BIGINT[], 'size': 0::BIGINT, 'o': a.o || {close} || list_transform(list_filter({runs}, lambda r: r <> ''), lambda r: {{'ix': [i], 'run': r}})}}
        WHEN a.size + length(cs[i]) > {target} AND (a.size >= {least} OR a.size + length(cs[i]) > {largest}) THEN {{'open': [i], 'size': length(cs[i]), 'o': a.o || {close}}}
        ELSE {{'open': a.open || [i], 'size': a.size + length(cs[i]), 'o': a.o}} END,
        {{'open': []::BIGINT[], 'size': 0::BIGINT, 'o': []::STRUCT(ix BIGINT[], run VARCHAR)[]}}) AS a FROM g1),
    g3 AS (SELECT id, kinds, cs, paths, levels, firsts, a.o || {close} AS gs FROM g2),
    g4 AS (SELECT id, kinds, cs, paths, levels, firsts, generate_subscripts(gs, 1) AS g, unnest(gs) AS x FROM g3),
    g5 AS (SELECT id AS doc, g, coalesce(x.run, array_to_string(list_transform(x.ix, lambda i: cs[i]), {_NL} || {_NL})) AS text, paths[x.ix[1]] AS section_path, levels[x.ix[1]] AS heading_level, firsts[x.ix[1]] AS start_line, firsts[x.ix[-1]] AS end_line,
      list_contains(list_transform(x.ix, lambda i: kinds[i]), 'table') AS has_table, list_contains(list_transform(x.ix, lambda i: kinds[i]), 'list') AS has_list FROM g4),
    plain AS (SELECT {{'doc': doc, 'g': g}} AS id, text FROM g5 WHERE NOT has_table),{atoms('plain')},
    cut AS (SELECT {{'doc': id.doc, 'g': id.g, 'n': atom_no}} AS id, text FROM atoms),{pieces('cut', largest)},
    made AS (SELECT p.id.doc AS doc, p.id.g AS g, p.id.n AS n, p.piece_no, p.text, a.kind, CASE WHEN p.keeps THEN a.words ELSE []::VARCHAR[] END AS words FROM pieces p JOIN atoms a ON a.id.doc = p.id.doc AND a.id.g = p.id.g AND a.atom_no = p.id.n
      UNION ALL SELECT doc, g, 0, 0, text, '其他', []::VARCHAR[] FROM g5 WHERE has_table),
    c1 AS (SELECT m.doc, row_number() OVER (PARTITION BY m.doc ORDER BY m.g, m.n, m.piece_no) - 1 AS chunk_no, m.text, m.kind, m.words, g5.* EXCLUDE (doc, g, text), g5.text AS whole, {sentences('m.text')} AS ss, coalesce(again.keys, []) AS keys
      FROM made m JOIN g5 ON g5.doc = m.doc AND g5.g = m.g LEFT JOIN again ON again.id = m.doc),
    c2 AS (SELECT *, list_transform(ss, lambda s: {{'t': s, 'why': CASE WHEN {strip('s')} = '' THEN '' WHEN regexp_matches({strip('s')}, {BOILER}) THEN 'boilerplate' WHEN list_contains(keys, {strip('s')}) THEN 'repetitive' ELSE '' END}}) AS infos FROM c1),
    c3 AS (SELECT *, len(infos) > 0 AND len(list_filter(infos, lambda s: s.why = '')) = 0 AS skip_embedding FROM c2)
    SELECT doc AS doc_id, chunk_no::INT AS chunk_no, text, CASE WHEN has_table THEN 'table' WHEN has_list THEN 'list' ELSE 'paragraph' END AS chunk_type, array_to_string(section_path, ' > ') AS section_path, heading_level::INT AS heading_level,
      array_to_string(list_sort(list_distinct(regexp_extract_all(whole, '!\\[.*?\\]\\((.*?)\\)', 1))), '|') AS image_refs, start_line::INT AS start_line, end_line::INT AS end_line, has_table, has_list, skip_embedding, kind AS semantic_type, array_to_string(words, '|') AS trigger_words,
      array_to_string(list_transform(infos, lambda s: s.t || chr(1) || s.why), chr(2)) AS sentence_infos, sha256(doc::VARCHAR || chr(1) || chunk_no::VARCHAR || chr(1) || text) AS chunk_id, length(text)::INT AS char_count,
      coalesce(nullif(regexp_extract(text, {quote(re2(ZH.clause))}), ''), '') AS clause_number, {core} AS is_core_section,
      CASE WHEN skip_embedding THEN '' WHEN len(infos) = 0 THEN text ELSE array_to_string(list_transform(list_filter(infos, lambda s: s.why = ''), lambda s: s.t), {_NL}) END AS embedding_text,
      coalesce((SELECT string_agg(s, '|' ORDER BY s) FROM (SELECT DISTINCT s FROM (VALUES {terms}) t(s, v) WHERE contains(c3.text, t.v))), '') AS key_terms FROM c3"""
