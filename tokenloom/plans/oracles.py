"""The registered queries again, as SQL over the same tables."""

from __future__ import annotations

from tokenloom.functions import chat as C
from tokenloom.functions.text import PRETOKENS, WHITESPACE
from tokenloom.operators.finetune import NO_SHAPE
from tokenloom.operators.indexing import PRIME, permutation_keys
from tokenloom.operators.merges import byte_names
from tokenloom.plans.inputs import (
    BATCH,
    CAPACITY,
    EOS_ID,
    MIN_LEN,
    PAD_ID,
    SEQ_LEN,
    SHARDS,
    WINDOW_UNITS,
    STAGE_BUDGETS,
    TOKENIZER,
)
from tokenloom.sources.special import FIRST_SPECIAL_ID, SPECIAL_TOKENS


def text(value: str) -> str:
    """A SQL string expression for any text; control characters are spelled with chr()."""
    out, plain = [], ""
    for c in value:
        if c.isprintable():
            plain += c.replace("'", "''")
        else:
            if plain:
                out.append(f"'{plain}'")
                plain = ""
            out.append(f"chr({ord(c)})")
    if plain or not out:
        out.append(f"'{plain}'")
    return "(" + " || ".join(out) + ")"


def fp(values: str) -> str:
    return f"md5(to_json({values})::varchar)"


WS = text(WHITESPACE)
WORDS = "'[^ ' || chr(9) || chr(13) || chr(10) || ']+'"
NL = "chr(10)"


def strip(value: str) -> str:
    return f"trim({value}, {WS})"


# Named parts in dependency order; a query uses the ones it names and those above them.
PARTS = {
    "docs": f"""select doc_id, source, text, regexp_extract_all(text, {WORDS}) as a from documents
        where length({strip('text')}) > 0""",
    "pieces": "select doc_id, unnest(a) as token, generate_subscripts(a, 1) as pos from docs",
    "vocab": """select token, count(*) as n,
        row_number() over (order by count(*) desc, token) as id from pieces group by token""",
    "coded": f"""select doc_id, pos, id from pieces join vocab using (token)
        union all select doc_id, len(a) + 1, {EOS_ID} from docs where len(a) > 0""",
    "ids": """select doc_id, source, list(id order by pos) as ids
        from coded join docs using (doc_id) group by doc_id, source""",
    "lens": "select doc_id, source, len(a) + 1 as n from docs where len(a) > 0",
    "chunk_lens": f"""select doc_id, source, b as block_no, least(n - b * {SEQ_LEN}, {SEQ_LEN}) as len
        from lens, lateral (select unnest(range(0, (n + {SEQ_LEN} - 1) // {SEQ_LEN})) as b)
        where least(n - b * {SEQ_LEN}, {SEQ_LEN}) >= {MIN_LEN}""",
    "unit_lens": f"""select doc_id, source, 0::bigint as block_no, n as len from lens where n <= {SEQ_LEN}
        union all select c.doc_id, c.source, c.block_no, c.len from chunk_lens c
        join lens using (doc_id) where n > {SEQ_LEN}""",
    "counts": """select source, doc_id, count(*) as k,
        row_number() over (partition by source order by doc_id) as rn
        from unit_lens group by source, doc_id""",
    "folded": f"""select source, rn, doc_id, 0 as window_id, k as cur from counts where rn = 1
        union all
        select c.source, c.rn, c.doc_id,
               case when f.cur >= {WINDOW_UNITS} then f.window_id + 1 else f.window_id end,
               case when f.cur >= {WINDOW_UNITS} then 0 else f.cur end + c.k
        from folded f join counts c on c.source = f.source and c.rn = f.rn + 1""",
    "items": f"""select u.source, f.window_id, u.doc_id, u.block_no, u.len,
        row_number() over (partition by u.source, f.window_id
                           order by u.len desc, u.doc_id, u.block_no) as rn
        from unit_lens u join folded f using (doc_id) where u.len between {MIN_LEN} and {CAPACITY}""",
    "fit": f"""select source, window_id, rn, doc_id, block_no, len, 1::bigint as b, [len] as fills
        from items where rn = 1
        union all
        select source, window_id, rn, doc_id, block_no, len, b,
               case when b > len(fills) then list_append(fills, len)
                    else list_transform(fills, lambda x, i: case when i = b then x + len else x end) end
        from (select i.source, i.window_id, i.rn, i.doc_id, i.block_no, i.len, f.fills,
                     coalesce(list_position(f.fills, list_max(list_filter(
                         f.fills, lambda x: x + i.len <= {CAPACITY}))), len(f.fills) + 1) as b
              from fit f join items i on i.source = f.source and i.window_id = f.window_id
                                     and i.rn = f.rn + 1)""",
    "bins": """select source, window_id, doc_id, block_no, len, b - 1 as bin,
        row_number() over (partition by source, window_id, b order by rn) - 1 as slot, rn from fit""",
    "sizes": f"""select source, window_id, bin, count(*) as n_units, sum(len)::bigint as n_tokens
        from bins group by all having sum(len) >= {MIN_LEN}""",
    "placed": f"""select b.source, b.window_id, b.bin, b.slot, b.len,
        i.ids[b.block_no * {SEQ_LEN} + 1 : b.block_no * {SEQ_LEN} + b.len] as part
        from bins b join ids i using (doc_id)""",
    "samples": """select source, window_id, bin, flatten(list(part order by slot)) as ids,
        flatten(list(range(0, len) order by slot)) as positions,
        list(len order by slot) as lens from placed group by all""",
    "seq_items": f"""select source, doc_id, block_no, len,
        row_number() over (partition by source order by doc_id, block_no) as rn
        from unit_lens where len <= {CAPACITY}""",
    "seq": f"""select source, rn, doc_id, block_no, len, 0::bigint as bin, len as cur
        from seq_items where rn = 1
        union all
        select i.source, i.rn, i.doc_id, i.block_no, i.len,
               case when s.cur + i.len > {CAPACITY} then s.bin + 1 else s.bin end,
               case when s.cur + i.len > {CAPACITY} then i.len else s.cur + i.len end
        from seq s join seq_items i on i.source = s.source and i.rn = s.rn + 1""",
}


def with_parts(body: str, *extra: tuple[str, str]) -> str:
    parts = [f"{name} as ({sql})" for name, sql in [*PARTS.items(), *extra]]
    return "with recursive " + ",\n".join(parts) + "\n" + body


def _merged_words() -> str:
    """The lowest-ranked, leftmost pair of every word merged in each step; a word is done when it has none."""
    names = "[" + ", ".join(f"chr({ord(c)})" for c in byte_names()) + "]"
    return f"""with recursive model as (select json_extract(content, '$.model') as m from read_text('{TOKENIZER}')),
        entries as (select unnest(map_entries(cast(json_extract(m, '$.vocab') as map(varchar, integer)))) as e from model),
        merges as (select min(rank) as rank, p[1] as l, p[2] as r from (
            select unnest(cast(json_extract(m, '$.merges') as varchar[][])) as p,
                   generate_subscripts(cast(json_extract(m, '$.merges') as varchar[][]), 1) as rank from model) group by all),
        words as (select distinct unnest(regexp_extract_all(text, {WORDS})) as w from documents),
        names as (select {names} as names),
        merged as (
            select w, 0 as step, list_transform(range(1, strlen(w) + 1),
                lambda i: names[('0x' || substr(hex(w), 2 * i - 1, 2))::int + 1]) as s from words, names
            union all
            select w, step + 1, s[1:p - 1] || [s[p] || s[p + 1]] || s[p + 2:] from (
                select w, step, s, min(m.rank * 1000000 + p) % 1000000 as p
                from (select w, step, s, unnest(range(1, len(s))) as p from merged) x
                join merges m on m.l = x.s[x.p] and m.r = x.s[x.p + 1] group by w, step, s)),
        done as (select w, arg_max(s, step) as s from merged group by w),
        coded as (select w, list(e.value order by pos) as ids from (
            select w, unnest(s) as symbol, generate_subscripts(s, 1) as pos from done) join entries on e.key = symbol group by w),
        placed as (select doc_id, unnest(a) as w, generate_subscripts(a, 1) as pos
            from (select doc_id, regexp_extract_all(text, {WORDS}) as a from documents)),
        ids as (select doc_id, flatten(list(ids order by pos)) as ids from placed join coded using (w) group by doc_id)
        select doc_id, coalesce(len(ids), 0)::bigint as n, {fp('coalesce(ids, [])')} as ids_md5
        from documents left join ids using (doc_id)"""


# --- conversations -----------------------------------------------------------------------

TURNS = "select conv_id, turn, role, text from conversations"
WRAPPED = f"""select conv_id, turn, role, case when role = 'user' and turn > 2
    then {text(C.RESPONSE_OPEN)} || {NL} || text || {NL} || {text(C.RESPONSE_CLOSE)} else text end as text
    from conversations"""
THINK = text("<think>\n\n</think>\n\n")


def rendered(turns: str, *, end: str = "''", head: str | None = None, after: str = "''",
             text_of: str = "text") -> tuple[tuple[str, str], ...]:
    """Parts ``t`` (numbered turns), ``q`` (last query) and ``prompts``."""
    system = head or "coalesce(max(case when idx = 0 and role = 'system' then " \
        f"{text(C.TURN_START + 'system' + chr(10))} || body || {text(C.TURN_END)} end), '')"
    is_query = f"""role = 'user' and not (starts_with(body, {text(C.RESPONSE_OPEN)})
        and ends_with(body, {text(C.RESPONSE_CLOSE)}))"""
    start = text(C.TURN_START)
    piece = f"""case
        when role = 'user' then {start} || 'user' || {NL} || body || {text(C.TURN_END)}
        when role = 'assistant' then {start} || 'assistant' || {NL}
             || case when idx > lq then {THINK} else '' end || body || {after} || {text(C.TURN_END)}
        when role = 'tool' then case when idx > 0 and prev <> 'tool' then {start} || 'user' else '' end
             || {text(chr(10) + C.RESPONSE_OPEN + chr(10))} || body || {text(chr(10) + C.RESPONSE_CLOSE)}
             || case when nxt is distinct from 'tool' then {text(C.TURN_END)} else '' end
        else '' end"""
    return (
        ("turns", turns),
        ("t", f"""select *, {strip(text_of)} as body,
            row_number() over (partition by conv_id order by turn) - 1 as idx,
            lag(role) over (partition by conv_id order by turn) as prev,
            lead(role) over (partition by conv_id order by turn) as nxt from turns"""),
        ("q", f"select conv_id, max(idx) as lq from t where {is_query} group by conv_id"),
        ("prompts", f"""select conv_id, {system} || string_agg({piece}, '' order by idx) || {end} as prompt
            from t join q using (conv_id) group by conv_id"""),
        ("pieces_t", f"""select conv_id, turn, case when idx = 0 and role = 'system' then
            {text(C.TURN_START + 'system' + chr(10))} || body || {text(C.TURN_END)} else '' end || {piece} as piece
            from t join q using (conv_id)"""),
    )


def piece_report(*parts: tuple[str, str]) -> str:
    return with_parts("select conv_id, turn, length(piece) as n, md5(piece) as piece_md5 from pieces_t", *parts)


def prompt_report(*parts: tuple[str, str], key: str = "conv_id") -> str:
    return with_parts(f"select {key}, length(prompt) as n, md5(prompt) as prompt_md5 from prompts", *parts)


def _genprompt() -> str:
    sql = []
    for on in (True, False):
        end = text(C.TURN_START + "assistant\n" + ("<think>\n" if on else "<think>\n\n</think>\n\n"))
        sql.append(f"""select conv_id, length(prompt || {end}) as n, md5(prompt || {end}) as prompt_md5,
            {str(on).lower()} as thinking from prompts""")
    return with_parts(" union all ".join(sql), *rendered(TURNS))


TOOL_TURNS = f"""select conv_id, turn * 3 as turn, role, text from conversations
    union all select conv_id, turn * 3 + k, 'tool', ' result ' || text || {NL}
    from conversations, (values (1), (2)) as x(k) where role = 'assistant'"""

CALL_TURNS = """select conv_id, turn, role,
    case when role = 'assistant' and turn % 4 = 1 then '' else text end as text, text as query
    from conversations"""


def _parameter(name: str, value: str) -> str:
    return f"{text(f'<parameter={name}>' + chr(10))} || {value} || {text(chr(10) + '</parameter>' + chr(10))}"


CALLS = " || ".join([
    f"case when length(body) > 0 then {NL} || {NL} else '' end",
    text("<tool_call>\n<function=search>\n"),
    _parameter("query", "query"), _parameter("turn", "turn::varchar"),
    _parameter("flag", "'True'"), _parameter("off", "'False'"), _parameter("none", "'None'"),
    _parameter("ratio", "'1.5'"), _parameter("deep", text('{"b": [1, 2], "a": "\\u00e9"}')),
    text("</function>\n</tool_call>\n<tool_call>\n<function=stop>\n</function>\n</tool_call>"),
])

TOOL_LINE = f"""{text('{"type": "function", "function": {"name": "f_')} || conv_id || {text(
    '", "description": "' + chr(92) + 'u00c9tude ' + chr(92) + '"x' + chr(92)
    + '"", "parameters": {"required": ["b", "a"], "depth": 1.0}}}')}"""
TOOL_HEAD = f"""{text(C.TURN_START + 'system' + chr(10) + C.TOOLS_INTRO + chr(10))} || {TOOL_LINE}
    || {text(C.TOOLS_RULES)}
    || coalesce(max(case when idx = 0 and role = 'system' and length(body) > 0
                    then {NL} || {NL} || body end), '') || {text(C.TURN_END)}"""


def _media(numbered: bool) -> str:
    def label(kind: str, number: str) -> str:
        return f"'{kind} ' || ({number}) || ': ' || " if numbered else ""

    before = "(count(*) filter (role = 'user') over (partition by conv_id order by turn) - 1)"
    return f"""case when role = 'user' then
        {label('Picture', before + ' * 2 + 1')} {text(C.IMAGE)} || text
        || {label('Video', before + ' + 1')} {text(C.VIDEO)}
        || {label('Picture', before + ' * 2 + 2')} {text(C.IMAGE)} else text end"""


def _contents(numbered: bool) -> str:
    return f"""with m as (select conv_id, turn, {_media(numbered)} as content from conversations)
        select conv_id, md5(string_agg(content, '|' order by turn)) as contents_md5 from m group by conv_id"""


_KINDS = {
    "valid": "''",
    "no_messages": f"'{C.NO_MESSAGES}'",
    # Without user turns an assistant or system turn is what may remain.
    "no_user": f"case when others = 0 then '{C.NO_MESSAGES}' else '{C.NO_QUERY}' end",
    "late_system": f"'{C.SYSTEM_NOT_FIRST}'",
    "bad_role": f"'{C.BAD_ROLE}'",
    "system_image": f"'{C.SYSTEM_IMAGE}' || case when opens_system then ';{C.SYSTEM_NOT_FIRST}' else '' end",
    "system_video": f"'{C.SYSTEM_VIDEO}' || case when opens_system then ';{C.SYSTEM_NOT_FIRST}' else '' end",
    "bad_part": f"'{C.BAD_PART}'",
    "bad_content": f"'{C.BAD_CONTENT}'",
    "bad_arguments": f"'{C.BAD_ARGUMENTS}'",
}


def _validate() -> str:
    rows = " union all ".join(f"select conv_id, '{k}' as kind, {v} as problem from c"
                              for k, v in _KINDS.items())
    return f"""with c as (select conv_id, count(*) filter (role <> 'user') as others,
        coalesce(bool_or(turn = 0 and role = 'system'), false) as opens_system
        from conversations group by conv_id) {rows}"""


def _thinking() -> str:
    t = "text"
    rows = {
        "plain": (strip(t), "''"),
        "tagged": (strip(f"{NL} || {NL} || {t}"), strip(f"rtrim({t}, {NL})")),
        "unopened": ("'answer'", strip(f"ltrim(rtrim({strip(t)}, {NL}), {NL})")),
        "twice": (strip(t), strip(f"ltrim(rtrim({t}, {NL}), {NL})")),
    }
    return " union all ".join(
        f"""select conv_id, turn, '{k}' as kind, md5({reasoning}) as reasoning_md5,
            md5({answer if k in ('plain', 'unopened') else f'ltrim(rtrim({strip(t + " || chr(32)")}), {NL})'})
            as answer_md5 from conversations"""
        for k, (answer, reasoning) in rows.items())


_SPECIAL_TABLE = ", ".join(
    f"({FIRST_SPECIAL_ID + i}, '{n}', {str(special).lower()})" for i, (n, special) in enumerate(SPECIAL_TOKENS))


def _special_counts() -> str:
    return with_parts(
        """select id, content, special,
            coalesce(sum((length(prompt) - length(replace(prompt, content, ''))) // length(content)), 0)::bigint as n
            from names cross join prompts group by id, content, special""",
        *rendered(TURNS), ("names", f"select * from (values {_SPECIAL_TABLE}) as s(id, content, special)"))


def _special() -> str:
    names = [name for name, _ in SPECIAL_TOKENS]
    any_of = "|".join(n.replace("|", "\\|") for n in names)
    table = ", ".join(f"('{n}', {FIRST_SPECIAL_ID + i})" for i, n in enumerate(names))
    return with_parts(
        "select conv_id, count(*) as n, md5('[' || string_agg(id, ',' order by pos) || ']') as ids_md5 "
        "from coded_p group by conv_id",
        *rendered(TURNS),
        ("special", f"select * from (values {table}) as s(token, id)"),
        ("segments", f"""select conv_id, list_filter(string_split(regexp_replace(
            prompt, '({any_of})', chr(1) || '\\1' || chr(1), 'g'), chr(1)), lambda s: length(s) > 0) as parts
            from prompts"""),
        ("numbered", """select conv_id, unnest(parts) as s, generate_subscripts(parts, 1) as seg_no
            from segments"""),
        ("split_p", f"""select conv_id, seg_no, case when s in (select token from special) then [s]
            else regexp_extract_all(s, {WORDS}) end as a from numbered"""),
        ("pieces_p", """select conv_id, row_number() over (partition by conv_id order by seg_no, k) as pos, token
            from (select conv_id, seg_no, unnest(a) as token, generate_subscripts(a, 1) as k from split_p)"""),
        ("vocab_p", """select token, row_number() over (order by count(*) desc, token) as id from pieces_p
            where token not in (select token from special) group by token"""),
        ("coded_p", """select conv_id, pos, id from pieces_p join
            (select token, id from vocab_p union all select token, id from special) using (token)"""),
    )


# --- fine-tuning rows --------------------------------------------------------------------

SFT = f"""select doc_id, text, lang, source, doc_id % 6 as shape,
    case doc_id % 6 when 0 then source when 1 then lang when 2 then lang || {NL} || source
                    when 3 then lang end as asked from documents"""
_SFT_PROMPT = f"""case when shape < 4 then {text(C.TURN_START + 'user' + chr(10))} || {strip('asked')}
    || {text(C.TURN_END + C.TURN_START + 'assistant' + chr(10))} || {THINK} || {strip('text')}
    || {text(C.TURN_END)} when shape = 4 then text end"""
_SFT_ERROR = NO_SHAPE.format("text")


def _plain_turns(asked: str, answer: str) -> str:
    return f"""{text(C.TURN_START + 'user' + chr(10))} || {asked} || {text(C.TURN_END + C.TURN_START + 'assistant' + chr(10))}
        || {THINK} || {answer} || {text(C.TURN_END)}"""


def _sft_scan() -> str:
    row = """concat_ws('~', case shape when 0 then source || '|' || text when 1 then '' else '-' end,
        case when shape in (0, 1) then lang else '-' end, case when shape in (0, 1) then text else '-' end,
        case when shape in (2, 3) then lang else '-' end,
        case shape when 2 then source when 3 then '' else '-' end,
        case when shape in (2, 3) then text else '-' end, case when shape = 4 then text else '-' end)"""
    return f"""with s as ({SFT}) select f as format, md5({row}) as row_md5
        from s, (values ('json'), ('parquet')) as x(f)"""


# --- text --------------------------------------------------------------------------------


def _nonblank() -> str:
    kinds = {"empty": "", "spaces": "   ", "breaks": "\t\n\r", "wide": "\xa0\u3000",
             "controls": "\x1c\x85", "zero_width": "\u200b"}
    rows = " union all ".join(
        [f"select doc_id, '{k}' as kind, {text(v)} as t from documents" for k, v in kinds.items()]
        + ["select doc_id, 'none', null from documents", "select doc_id, 'text', text from documents"])
    return f"select doc_id, kind from ({rows}) where length({strip('t')}) > 0"


def _jsonl() -> str:
    good = "json_object('doc', doc_id, 'text', text)::varchar"
    lines = {
        "good": good, "padded": f"' ' || chr(9) || {good} || '  '",
        "number": "'{\"doc\":' || doc_id || ',\"text\":5}'",
        "null": "'{\"doc\":' || doc_id || ',\"text\":null}'",
        "blank": "'{\"doc\":' || doc_id || ',\"text\":\"  \"}'",
        "absent": "'{\"doc\":' || doc_id || '}'",
        "nested": "'{\"text\":{\"text\":' || doc_id || '}}'",
        "list": f"'[' || {good} || ']'",
        "cut": f"left({good}, -1)", "twice": f"{good} || ' ' || {good}", "bare": "doc_id::varchar",
    }
    rows = [f"select doc_id as row_id, '{k}' as kind, {v} as line from documents" for k, v in lines.items()]
    rows += ["select event_id, 'props', props from events",
             "select event_id, 'event', '{\"text\":\"event ' || event_id || '\",' || substr(props, 2) from events"]
    return f"""with lines as ({' union all '.join(rows)}),
        valid as (select *, case when json_valid(line) then line end as ok from lines),
        found as (select row_id, kind, case when json_type(ok) = 'OBJECT'
            and json_type(ok, '$.text') = 'VARCHAR' then json_extract_string(ok, '$.text') end as t from valid)
        select row_id, kind, md5(t) as text_md5 from found where length({strip('t')}) > 0"""


def _pretokenize() -> str:
    """RE2 has no look-ahead. A whitespace run before a non-space gives its last character to what
    follows; marking that spot first and matching the parts on their own has the same effect."""
    rule = PRETOKENS.replace(r"|\s+(?!\S)", "").replace("'", "''")
    return f"""with marked as (select doc_id, text, string_split(regexp_replace(text,
            '(\\s)([^\\S\\r\\n]\\S)', '\\1' || chr(1) || '\\2', 'g'), chr(1)) as parts from documents),
        p as (select doc_id, text, flatten(list_transform(parts,
            lambda s: regexp_extract_all(s, '{rule}'))) as a from marked)
        select doc_id, len(a) as n_pieces, md5(array_to_string(a, chr(31))) as pieces_md5,
            array_to_string(a, '') = text as lossless from p"""


TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()

_CHUNKS = f"""select doc_id, block_no, len as n,
    {fp(f'ids[block_no * {SEQ_LEN} + 1 : block_no * {SEQ_LEN} + len]')} as ids_md5
    from chunk_lens join ids using (doc_id)"""
_ARRAYS = f"""{fp(f'list_resize(ids, width, {PAD_ID})')} as ids_md5,
    {fp('list_resize(ids, width, -100)')} as labels_md5,
    {fp('list_resize(positions, width, -1)')} as positions_md5,
    {fp('list_resize(list_transform(ids, lambda x: 1), width, 0)')} as mask_md5"""
_PADDED = f"""select source, window_id::bigint as window_id, bin, width, {_ARRAYS}
    from (select *, {CAPACITY}::bigint as width from samples)"""
_BATCHES = f"""select source, doc_id, block_no, len, rn // {BATCH} as batch_id, rn % {BATCH} as row_in_batch
    from (select *, row_number() over (partition by source order by doc_id, block_no) - 1 as rn
          from chunk_lens)"""
_SEGMENTS = """select source, window_id, bin, s, unnest(lens) as len,
    unnest(range(0, len(lens))) as segment from (select *, 0 as s from samples)"""
_STARTS = "list_transform(lens, lambda x, i: coalesce(list_sum(lens[1 : i - 1]), 0)::bigint)"


def _summary(name: str, sizes: str) -> str:
    return f"""select '{name}' as strategy, count(*) as samples, sum(n_tokens)::bigint as total_tokens,
        count(*) * {CAPACITY} as total_capacity,
        sum(n_tokens)::double / (count(*) * {CAPACITY}) as utilization,
        printf('%.2f%%', 100 * sum(n_tokens)::double / (count(*) * {CAPACITY})) as shown from {sizes}"""


_STAGE_ROWS = "select *, sum(len) over (order by doc_id, block_no) - len as before from chunk_lens"
_STAGES = ", ".join(f"('{name}', {sum(t for _, t in STAGE_BUDGETS[:k])}, {tokens})" for k, (name, tokens) in enumerate(STAGE_BUDGETS))
_STAGE_CUT = f"""select source, doc_id, block_no, len::bigint as len, stage, (greatest(before, low) - before)::bigint as start,
    (least(before + len, low + size) - greatest(before, low))::bigint as take
    from ({_STAGE_ROWS}), (values {_STAGES}) as b(stage, low, size) where least(before + len, low + size) > greatest(before, low)"""


def _permuted() -> str:
    """The permutation's rounds, spelled out on the two digits of each number."""
    _, _, keys = permutation_keys(0, 7)
    sql = "select source, doc_id, block_no, len, x // base as l, x % base as r, n, side, base from start"
    for a, b, c, d in keys:
        sql = f"select * replace ((l + (r * {a} + {b}) % {PRIME}) % side as l) from ({sql})"
        sql = f"select * replace ((r + (l * {c} + {d}) % {PRIME}) % base as r) from ({sql})"
    step = f"select source, doc_id, block_no, len, l * base + r as x, n, side, base from ({sql})"
    return with_parts(
        f"""select source, doc_id, block_no, len, x // {BATCH} as batch_id, x % {BATCH} as row_in_batch from walk where done""",
        ("numbered", """select *, row_number() over (order by doc_id, block_no) - 1 as x, count(*) over () as n from chunk_lens"""),
        ("sized", "select *, ceil(sqrt(n::double))::bigint as side from numbered"),
        ("based", "select *, (n + side - 1) // side as base from sized"),
        ("walk", f"""select source, doc_id, block_no, len, x, n, side, base, false as done from based
            union all select source, doc_id, block_no, len, x, n, side, base, x < n as done
            from ({step.replace('from start', 'from walk where not done')})"""))


SQL: dict[str, str] = {
    "scan_text": "select doc_id, length(text) as n, md5(text) as text_md5 from documents",
    "nonblank_text": _nonblank(),
    "preview_text": f"""select doc_id, md5(text) as text_md5 from documents
        where length({strip('text')}) > 0 order by doc_id limit 10""",
    "jsonl_strict": _jsonl(),
    "shard_rows": f"""select doc_id, (row_number() over (order by doc_id) - 1) % {SHARDS} as shard
        from documents""",
    "shard_files": f"""select doc_id, (row_number() over (order by doc_id) - 1) % {SHARDS} as shard, md5(text) as text_md5
        from documents""",
    "empty_guard": f"""select 'documents' as rows, count(*) = 0 as is_empty from documents
        union all select 'blank', count(*) = 0 from documents
        where coalesce(length({strip('text')}), 0) = 0""",
    "vocab_build": with_parts("select token, n, id from vocab"),
    "vocab_table": with_parts("select token, id from vocab"),
    "pretokenize": _pretokenize(),
    "encode_corpus": with_parts(f"select doc_id, len(ids) as n, {fp('ids')} as ids_md5 from ids"),
    "encode_small_head": with_parts(f"select nullif(doc_id % 7, 0) as key, len(ids) as n, {fp('ids')} as ids_md5 from ids"),
    "encode_merges": _merged_words(),
    "encode_special": _special(),
    "special_tokens": _special_counts(),
    "chunk_documents": with_parts(_CHUNKS),
    "training_path": with_parts(f"""select f as format, block_no, n, ids_md5
        from ({_CHUNKS}), (values ('jsonl'), ('parquet')) as x(f)"""),
    "pack_units": with_parts("select doc_id, source, block_no, len from unit_lens"),
    "pack_windows": with_parts("select source, doc_id, window_id::bigint as window_id from folded"),
    "pack_windows_chained": with_parts("select source, doc_id, window_id::bigint as window_id from folded"),
    "pack_nextfit_chained": with_parts("select source, doc_id, block_no, bin from seq"),
    "pack_nextfit": with_parts("select source, doc_id, block_no, bin from seq"),
    "pack_bfd": with_parts("""select source, window_id::bigint as window_id, doc_id, block_no, len,
        bin, slot from bins"""),
    "pack_materialize": with_parts(f"""select source, window_id::bigint as window_id, bin,
        len(ids) as n_tokens, {fp('ids')} as ids_md5, {fp('positions')} as positions_md5,
        {fp(_STARTS)} as starts_md5 from samples"""),
    "pack_padded": with_parts(_PADDED),
    "pack_loose_keys": with_parts(f"""select nullif(u.source, 'src0') as source, sum(len)::bigint as n_tokens,
        sum(list_sum(ids[block_no * {SEQ_LEN} + 1 : block_no * {SEQ_LEN} + len]))::bigint as id_sum
        from unit_lens u join ids using (doc_id) where len between {MIN_LEN} and {CAPACITY} group by 1"""),
    "collate_loose_keys": with_parts(f"""select nullif(c.source, 'src0') as source, count(*) as rows, sum(len)::bigint as n_tokens,
        sum(list_sum(ids[block_no * {SEQ_LEN} + 1 : block_no * {SEQ_LEN} + len]))::bigint as id_sum,
        (count(*) + {BATCH} - 1) // {BATCH} as batches from chunk_lens c join ids using (doc_id) group by 1"""),
    "pack_summary": with_parts(_summary("best_fit", "sizes")),
    "pack_first_samples": with_parts("""select source, window_id::bigint as window_id, bin, n_units,
        n_tokens from sizes order by source, window_id, bin limit 10"""),
    "pack_compare": with_parts(
        _summary("sequential", "(select source, bin, sum(len) as n_tokens from seq group by all)")
        + " union all " + _summary("best_fit", "sizes")),
    "batch_assign": with_parts(_BATCHES),
    "batch_shuffled": with_parts(f"""select source, doc_id, block_no, len, rn // {BATCH} as batch_id,
        rn % {BATCH} as row_in_batch from (select *, row_number() over (
            order by md5('7:' || doc_id || ':' || block_no), doc_id, block_no) - 1 as rn from chunk_lens)"""),
    "collate_batch": with_parts(f"""select source, batch_id, row_in_batch, width, {_ARRAYS} from (
        select b.source, batch_id, row_in_batch, max(len) over (partition by b.source, batch_id) as width,
            i.ids[block_no * {SEQ_LEN} + 1 : block_no * {SEQ_LEN} + len] as ids,
            range(0, len) as positions from ({_BATCHES}) b join ids i using (doc_id))"""),
    "segment_index": with_parts(f"""select source, window_id::bigint as window_id, bin,
        len(lens) as n_segments, {fp(f'''list_resize(flatten(list_transform(lens,
            lambda x, i: list_transform(range(0, x), lambda y: i - 1))), {CAPACITY}, -1)''')} as segments_md5
        from samples"""),
    "mask_pairs": with_parts(f"""select source, window_id::bigint as window_id, bin, segment,
        len as n_positions, first_key, (len * (len + 1) // 2)::bigint as pairs,
        list_sum(list_transform(range(0, len), lambda x: (first_key + x) * (x + 1)))::bigint as checksum
        from (select source, window_id, bin, unnest(lens) as len, unnest({_STARTS}) as first_key,
                     unnest(range(0, len(lens))) as segment from samples)"""),
    "mask_text": with_parts("""select source, window_id::bigint as window_id, bin, i as row,
        md5(array_to_string(list_transform(range(0, len(seg)),
            lambda j: case when j <= i and seg[j + 1] = seg[i + 1] then '1' else '0' end), ' ')) as bits_md5
        from (select *, unnest(range(0, len(seg))) as i from (
            select source, window_id, bin, flatten(list_transform(lens,
                lambda x, i: list_transform(range(0, x), lambda y: i))) as seg
            from samples order by source, window_id, bin limit 3))"""),
    "step_plan": with_parts("""select rn // 64 as step, count(*) as rows, sum(len)::bigint as tokens,
        sum(len) >= 12000 as meets_budget
        from (select len, row_number() over (order by doc_id, block_no) - 1 as rn from chunk_lens)
        group by step"""),
    "stage_cut": with_parts(_STAGE_CUT),
    "stage_plan": with_parts(f"""select stage, count(*) as rows, sum(take)::bigint as tokens,
        ceil(sum(take) / 1000.0)::bigint as updates from ({_STAGE_CUT}) group by stage"""),
    "batch_permuted": _permuted(),
    "write_counted": f"""select count(*) as rows, sum(length(text))::bigint as chars, max(doc_id) as last_id
        from documents where length({strip('text')}) > 0""",
    "sft_scan": _sft_scan(),
    "sft_format": f"""with s as ({SFT}) select doc_id, md5({_SFT_PROMPT}) as prompt_md5,
        case when shape = 5 then '{_SFT_ERROR}' else '' end as problem from s""",
    "sft_rich": f"""select f as format, md5(case doc_id % 4
        when 0 then {text(C.TURN_START + 'user' + chr(10))} || {strip("source || ' asks'")} || {text(C.TURN_END + C.TURN_START + 'assistant' + chr(10)
            + '<think>' + chr(10) + 'weighs it' + chr(10) + '</think>' + chr(10) * 2 + 'done' + chr(10) * 2
            + '<tool_call>' + chr(10) + '<function=find>' + chr(10) + '<parameter=id>' + chr(10))} || doc_id || {text(
            chr(10) + '</parameter>' + chr(10) + '<parameter=deep>' + chr(10) + 'True' + chr(10) + '</parameter>' + chr(10)
            + '</function>' + chr(10) + '</tool_call>' + C.TURN_END)}
        when 1 then {_plain_turns('n_chars', "case when n_chars > 1000 then 'True' else 'False' end")}
        when 2 then {_plain_turns(strip('source'), "(n_chars // 2) || case when n_chars % 2 = 0 then '.0' else '.5' end")}
        else text end) as prompt_md5 from documents, (values ('jsonl'), ('parquet')) as x(f)""",
    "sft_truncate": f"""with s as ({SFT}),
        p as (select doc_id, regexp_extract_all(prompt, {WORDS}) as a
              from (select doc_id, {_SFT_PROMPT} as prompt from s) where prompt is not null),
        w as (select doc_id, unnest(a) as token, generate_subscripts(a, 1) as pos from p),
        v as (select token, row_number() over (order by count(*) desc, token) as id from w group by token)
        select doc_id, count(*) as n, md5('[' || string_agg(id, ',' order by pos) || ']') as ids_md5
        from w join v using (token) where pos <= 64 group by doc_id""",
    "last_query": f"""select conv_id, max(turn) filter (role = 'user' and not (
        starts_with({strip('text')}, {text(C.RESPONSE_OPEN)})
        and ends_with({strip('text')}, {text(C.RESPONSE_CLOSE)}))) as last_query
        from ({WRAPPED}) group by conv_id""",
    "render_chat": prompt_report(*rendered(TURNS)),
    "render_responses": prompt_report(*rendered(WRAPPED)),
    "render_genprompt": _genprompt(),
    "prompt_manifest": with_parts("""select id, id || '.prompt.txt' as file_name, md5(prompt) as prompt_md5
        from (select prompt, case when conv_id % 2 = 0 then 'chat-' || conv_id
                     else printf('sample_%03d', row_number() over (order by conv_id) - 1) end as id from prompts)""",
        *rendered(TURNS)),
    "think_split": _thinking(),
    "render_tool_calls": prompt_report(*rendered(CALL_TURNS, after=CALLS)),
    "render_tool_results": prompt_report(*rendered(TOOL_TURNS)),
    "render_tools": prompt_report(*rendered(TURNS, head=TOOL_HEAD)),
    "json_indent": """select conv_id, length(t) as n, md5(t) as text_md5 from (
        select conv_id, json_pretty(json_object('conv_id', conv_id, 'turns', to_json(list(
            json_object('turn', turn, 'role', role, 'text', text)
            order by turn nulls first, role nulls first, text nulls first)))) as t
        from conversations group by conv_id)""",
    "content_normalize": _contents(False),
    "media_count": _contents(True),
    "render_media": prompt_report(*rendered(
        f"select conv_id, turn, role, {_media(True)} as text from conversations")),
    "render_turn_rows": piece_report(*rendered(TOOL_TURNS)),
    "render_turn_media": piece_report(*rendered(f"select conv_id, turn, role, {_media(True)} as text from conversations")),
    "chat_validate": _validate(),
    "chat_samples": prompt_report(*rendered(TURNS), key="conv_id::varchar as id"),
    "expectation_check": f"""with a as (select conv_id, arg_max(text, turn) as answer from conversations
            group by conv_id),
        c as (select conv_id::varchar as id, contains(answer, '.') as includes_all,
            length(answer) between 40 and 400 as length_ok, conv_id % 3 <> 0 as tool_ok from a)
        select id, includes_all, length_ok, tool_ok, includes_all and length_ok and tool_ok as passed from c""",
    "stream_chunk": with_parts(_CHUNKS),
    "stream_small_head": with_parts(_CHUNKS),
    "stream_pack": with_parts(_PADDED),
    "stream_pack_resumed": with_parts(_PADDED),
}
