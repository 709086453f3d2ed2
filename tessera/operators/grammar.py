"""The grammar of templates, read by one fold over their tokens in Column functions.

A source is cut into tags, a tag into tokens, and every token gets a kind from itself and its neighbours: a parenthesis after an operand is a
call, one after a filter's or test's name holds arguments, any other groups. The fold then keeps what a parser keeps:
the path that is being read, a stack of open brackets with the path before each, and a stack of open blocks with the names
each of them binds. A path is shifted while dots and indexes follow it and reduced to a read by whatever else does.

Names are resolved where they stand: a loop's variables are bound in its body and condition, not in what it runs over, in its else or
after it. A path counts if its first name is read anywhere without being bound.

A dictionary's closing brace right before the end of a tag needs a space between them; names bound in one branch of a condition count as
bound after it. Defined cases: null gives null; an empty source has no reads; what doesn't follow the grammar gives the paragraph of
the first error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Filters that templates may use; names that they may not; the words that read as constants and operators.
FILTERS = ("upper", "lower", "title", "trim", "default", "length", "join", "replace", "first", "last")
DANGEROUS = ("self", "config", "request", "session", "g", "url_for", "get_flashed_messages", "lipsum", "cycler", "joiner", "namespace", "range", "dict")
GLOBALS = ("range", "dict", "lipsum", "cycler", "joiner", "namespace")
CONSTANTS = ("true", "false", "none", "True", "False", "None")
WORDS = ("and", "or", "not", "in", "is", "if", "else")
INCLUSIONS = {"include": "include", "extends": "extends", "import": "import", "from": "fromimport"}
# What each broken rule is called.
SAID = {"attribute": "truy cập thuộc tính nội bộ '.{}'", "item": "truy cập thuộc tính nội bộ ['{}']", "call": "lời gọi hàm", "global": "tên toàn cục '{}'", "tag": "thẻ {}", "filter": "bộ lọc '{}' ngoài danh sách cho phép"}

BLOCKS = ("for", "if", "set", "macro", "call", "filter", "with", "autoescape", "block")
# Patterns name quotes by number, so that they can stand in SQL as raw strings.
_TEXT = r"\x27(?:[^\x27\\]|\\.)*+\x27|\x22(?:[^\x22\\]|\\.)*+\x22"
_BODY = rf"(?:[^\x22\x27{{}}%]++|{_TEXT}|\}}(?!\}})|%(?!\}})|\{{(?![{{%]))*+"
_RAW = r"\{%[-+]?\s*raw\s*[-+]?%\}"
#: A comment, a raw block, or a tag; the body of a tag has whole strings only, so that what they hold doesn't end it.
TAG = rf"(?s)\{{#.*?#\}}|{_RAW}.*?\{{%[-+]?\s*endraw\s*[-+]?%\}}|\{{\{{{_BODY}\}}\}}|\{{%{_BODY}%\}}"
TOKEN = rf"(?sU)({_TEXT}|\d+(?:\.\d+)?(?:[eE][-+]?\d+)?(?!\w)|\w+|//|\*\*|[=!<>]=|\S)"
_BINARY = r"^(?://|\*\*|[=!<>]=|[-+*/%~=<>])\z"


def _list(words: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _say(kind: str, what: str = "''") -> str:
    before, _, after = SAID[kind].partition("{}")
    quoted = lambda x: '"' + x + '"'
    return f"concat({quoted(before)}, {what}, {quoted(after)})"


def _words(source: str) -> str:
    """An array of (w, nl): the tokens of all tags between the marks of their ends, each with the line breaks before it; text is one token."""
    breaks = lambda x: f"(length({x}) - length(replace({x}, char(10), '')))"
    word = lambda w, nl: f"named_struct('w', {w}, 'nl', {nl})"
    stray = r"(?s)(?:\{\{|\{%).*"
    body = r"regexp_replace(tag, r'^\{[{%][-+]?|[-+]?[%}]\}\z', '')"
    cut = breaks(f"regexp_replace(piece, r'{stray}', '')")
    text = f"if(piece rlike r'{stray}', {word(repr('<stray>'), cut)}, {word(repr('<text>'), breaks('piece'))})"
    inside = f"transform(regexp_extract_all({body}, r'{TOKEN}', 1), w -> {word('w', '0')})"
    tag = f"if(left(tag, 2) = '{{#' or tag rlike r'^{_RAW}', array({word(repr('<text>'), breaks('tag'))}), concat(array({word('left(tag, 2)', '0')}), {inside}, array({word('right(tag, 2)', breaks('tag'))})))"
    none = "cast(array() as array<struct<w:string,nl:int>>)"
    return f"flatten(zip_with(split({source}, r'{TAG}', -1), regexp_extract_all({source}, r'{TAG}', 0), (piece, tag) -> concat(array({text}), if(tag is null, {none}, {tag}))))"


def _kinds(words: str) -> str:
    """An array of (w, nl, k, bad) from words: each token's kind, and whether it can't stand where it does."""
    name = lambda x: f"({x} rlike r'^(?U)[\\p{{L}}_]\\w*\\z')"
    text, number = lambda x: f"({x} rlike r'^[\\x22\\x27].')", lambda x: f"({x} rlike r'^\\d[\\d.eE+-]*\\z')"
    constant = lambda x: f"({x} in {_list(CONSTANTS)} or {text(x)} or {number(x)})"
    near = lambda n: f"if(i + {n} between 0 and size({words}) - 1, {words}[greatest(least(i + {n}, size({words}) - 1), 0)].w, '')"
    w, one, two, three, after, ended = "y.x.w", "y.n.one", "y.n.two", "y.n.three", "y.n.after", "y.ended"
    named = f"({two} = '|' or {two} = 'is' or ({two} = 'not' and {three} = 'is'))"
    is_ended = f"({one} in (')', ']', '}}') or {constant(one)} or ({name(one)} and ({two} = '.' or {named} or {one} not in {_list(WORDS)}) and {two} <> '{{%'))"
    kind = f"""case
      when {w} in ('<text>', '<stray>', '{{{{', '}}}}', '{{%', '%}}') then {w}
      when {one} = '{{%' then 'tag'
      when {one} = '.' and ({name(w)} or {number(w)}) then 'attr'
      when ({one} = '|' or ({one} = 'filter' and {two} = '{{%')) and {name(w)} then 'filter'
      when ({one} = 'is' and {w} <> 'not' or ({one} = 'not' and {two} = 'is')) and {name(w)} then 'test'
      when {w} in {_list(WORDS)} or ({w} = 'recursive' and {after} in ('%}}', 'if')) then 'op'
      when {constant(w)} then 'const'
      when {name(w)} then if({after} = '=', 'assign', 'name')
      when {w} = '(' then case when {named} and {name(one)} then 'args' when {ended} then 'call' else 'group' end
      when {w} = '[' then if({ended}, 'index', 'list')
      when {w} = '{{' then 'dict'
      when {w} in (')', ']', '}}') then 'close'
      when {w} = '.' then 'dot' when {w} = '|' then 'pipe' when {w} in (',', ':') then 'comma'
      when {w} rlike r'{_BINARY}' then 'op'
      else 'other' end"""
    open_end = f"(({one} rlike r'{_BINARY}' or {one} in {_list(WORDS)}) and {two} not in ('.', '|', '{{%', 'is') and not {named})"
    alone = f"({one} = '{{%' or {two} = '{{%' and {one} in ('if', 'elif', 'for', 'set', 'print', 'include', 'extends', 'import', 'from'))"
    bad = f"""case
      when y.k in ('<stray>', 'other') then true
      when {one} = '.' and y.k <> 'attr' or {one} = '|' and y.k <> 'filter' then true
      when y.k in ('name', 'const', 'dict', 'assign') then {ended} and not ({text(w)} and {text(one)}) and not {named}
      when y.k in ('pipe', 'dot') then not {ended}
      when y.k = 'op' then not {ended} and {w} not in ('not', '-', '+') and not ({w} = 'in' and {one} = 'not')
      when y.k in ('close', '}}}}', '%}}') then {open_end} or (y.k = '}}}}' and {one} = '{{{{') or (y.k = '%}}' and {alone})
      else false end"""
    around = f"named_struct('one', {near(-1)}, 'two', {near(-2)}, 'three', {near(-3)}, 'after', {near(1)})"
    steps = f"transform({words}, (x, i) -> named_struct('x', x, 'n', {around}))"
    steps = f"transform({steps}, y -> named_struct('x', y.x, 'n', y.n, 'ended', {is_ended}))"
    steps = f"transform({steps}, y -> named_struct('x', y.x, 'n', y.n, 'ended', y.ended, 'k', {kind}))"
    return f"transform({steps}, y -> named_struct('w', y.x.w, 'nl', y.x.nl, 'k', y.k, 'bad', {bad}))"


_EMPTY = """named_struct('line', 0, 'tag', '', 'phase', '', 'chain', cast(null as string), 'ops', false,
  'stack', cast(array() as array<struct<open:string,base:string,n:int,arg:string,ops:boolean>>),
  'blocks', array(named_struct('name', '', 'names', cast(array() as array<string>))), 'targets', cast(array() as array<string>),
  'free', cast(array() as array<string>), 'paths', cast(array() as array<string>), 'loops', cast(array() as array<string>),
  'found', cast(array() as array<string>), 'loop', false, 'cond', false, 'error', cast(null as int))"""


def _step() -> str:
    """The state after token t in state s."""
    top, block = "try_element_at(s.stack, -1)", "try_element_at(s.blocks, -1)"
    below = lambda x: f"slice({x}, 1, greatest(size({x}) - 1, 0))"
    inside = "size(s.stack) > 0"
    closing = "s.tag in ('endfor', 'endif', 'endset', 'endmacro', 'endcall', 'endfilter', 'endwith', 'endautoescape', 'endblock')"
    target = f"(s.phase = 'target' and t.k in ('name', 'assign') or t.k = 'assign' and (s.tag = 'with' and not {inside} or s.tag = 'macro') or s.tag in ('macro', 'import', 'from') and t.k = 'name')"
    read = f"(t.k = 'name' and s.tag not in ('macro', 'import', 'from', 'block', 'endblock', 'endmacro') and s.phase <> 'target')"
    condition = f"(t.w = 'if' and t.k = 'op' and s.tag = 'for' and s.phase = 'expr' and not {inside})"
    iterated = f"({condition} or t.w = 'recursive' and t.k = 'op' and s.tag = 'for' or t.k = '%}}' and s.tag = 'for' and s.phase = 'expr')"
    reduced = f"(t.k in ('op', 'comma', 'pipe', '}}}}', '%}}', 'call') or t.k = 'close' and ({top}.open <> 'group' or s.ops))"
    item = f"({top}.open = 'index' and {top}.n = 1 and {top}.arg is not null)"
    value = f"substring({top}.arg, 2, length({top}.arg) - 2)"
    quoted = f"if(startswith({top}.arg, char(34)) and not contains({value}, char(39)), concat(char(39), {value}, char(39)), {top}.arg)"
    chain = f"""case t.k when 'name' then if({read}, t.w, null)
      when 'attr' then if(t.w rlike r'^\\d', concat(s.chain, '[', t.w, ']'), concat(s.chain, '.', t.w)) when 'dot' then s.chain
      when 'close' then case when {top}.open = 'index' then concat({top}.base, '[', if({item}, {quoted}, ''), ']') when {top}.open = 'group' and not s.ops then s.chain end end"""
    opened = "t.k in ('call', 'args', 'group', 'index', 'list', 'dict')"
    counted = f"transform(s.stack, (f, i) -> if(i = size(s.stack) - 1 and t.k <> 'close', named_struct('open', f.open, 'base', f.base, 'n', f.n + 1, 'arg', if(f.n = 0 and t.k = 'const' and t.w not in {_list(CONSTANTS)}, t.w, null), 'ops', f.ops), f))"
    stack = f"""case when {opened} then array_append({counted}, named_struct('open', t.k, 'base', if(t.k = 'index', s.chain, null), 'n', 0, 'arg', cast(null as string), 'ops', s.ops))
      when t.k = 'close' then {below('s.stack')} when t.k in ('{{{{', '{{%') then slice(s.stack, 1, 0) else {counted} end"""
    push = lambda name, names: f"array_append(s.blocks, named_struct('name', {name}, 'names', {names}))"
    bind = lambda blocks, names: f"transform({blocks}, (b, i) -> if(i = size({blocks}) - 1, named_struct('name', b.name, 'names', concat(b.names, {names})), b))"
    nothing = "cast(array() as array<string>)"
    blocks = f"""case when {condition} then {push("'for'", "array_append(s.targets, 'loop')")}
      when t.k <> '%}}' then s.blocks
      when s.tag = 'for' then if(s.phase = 'cond', s.blocks, {push("'for'", "array_append(s.targets, 'loop')")})
      when s.tag = 'set' and s.phase = 'expr' or s.tag in ('import', 'from') then {bind('s.blocks', 's.targets')}
      when s.tag in {_list(BLOCKS)} then {push('s.tag', 's.targets')}
      when s.tag = 'else' then transform(s.blocks, (b, i) -> if(i = size(s.blocks) - 1 and b.name = 'for', named_struct('name', 'for', 'names', {nothing}), b))
      when {closing} and substring(s.tag, 4) in ('if', 'set') then {bind(below('s.blocks'), f'{block}.names')}
      when {closing} then {below('s.blocks')}
      else s.blocks end"""
    wrong = f"""t.bad and not (s.tag in ('import', 'from', 'include', 'block', 'macro', 'call', 'endblock', 'endmacro') and t.k in ('name', 'assign', 'op')) or t.k = 'close' and not coalesce(case t.w
        when ')' then {top}.open in ('call', 'args', 'group') when ']' then {top}.open in ('index', 'list') else {top}.open = 'dict' end, false)
      or t.k in ('}}}}', '%}}') and {inside}
      or t.k = '%}}' and case when {closing} then {block}.name <> substring(s.tag, 4) when s.tag = 'elif' then {block}.name <> 'if' when s.tag = 'else' then {block}.name not in ('if', 'for')
        when s.tag = 'for' then s.phase = 'target' else s.tag not in {_list((*BLOCKS, *INCLUSIONS, 'print'))} end"""
    found = f"""case when t.k = 'attr' and startswith(t.w, '_') then {_say('attribute', 't.w')}
      when t.k = 'close' and {item} and startswith({value}, '_') and {top}.arg rlike r'^[\\x22\\x27]' then {_say('item', value)}
      when t.k = 'call' and s.tag <> 'macro' then {_say('call')}
      when ({read} or {target}) and t.w in {_list(DANGEROUS)} then {_say('global', 't.w')}
      when t.k = 'tag' and t.w in {_list(tuple(INCLUSIONS))} then {_say('tag', "if(t.w = 'from', 'fromimport', t.w)")}
      when t.k = 'filter' and t.w not in {_list(FILTERS)} then {_say('filter', 't.w')} end"""
    add = lambda what, x: f"if({x} is null, s.{what}, array_append(s.{what}, {x}))"
    unbound = f"{read} and t.w not in {_list(GLOBALS)} and not exists(s.blocks, b -> array_contains(b.names, t.w))"
    stored = f"{target} and s.tag not in ('import', 'from') and not (s.tag = 'macro' and not {inside})"
    return f"""named_struct('line', s.line + t.nl,
      'tag', case t.k when '{{{{' then '' when '{{%' then '' when 'tag' then t.w else s.tag end,
      'phase', case when t.k = 'tag' then if(t.w in ('for', 'set'), 'target', 'expr') when t.k in ('{{{{', '{{%') then 'expr'
        when s.phase = 'target' and s.tag = 'for' and t.w = 'in' or s.phase = 'target' and s.tag = 'set' and t.w = '=' then 'expr' when {condition} then 'cond' else s.phase end,
      'chain', {chain},
      'ops', case when {opened} then false when t.k = 'close' then {top}.ops when s.phase = 'target' and t.w in ('in', '=') or t.k in ('{{{{', '{{%') then false when t.k in ('op', 'comma', 'pipe') then true else s.ops end,
      'stack', {stack},
      'blocks', {blocks},
      'targets', case when t.k in ('{{{{', '{{%') then {nothing} when {target} then array_append(s.targets, t.w) else s.targets end,
      'free', {add('free', f"if({unbound}, t.w, null)")},
      'paths', {add('paths', f"case when {stored} then t.w when {reduced} then s.chain end")},
      'loops', {add('loops', f"if({iterated} and not s.ops, s.chain, null)")},
      'found', {add('found', found)},
      'loop', s.loop or t.k = '%}}' and s.tag = 'for', 'cond', s.cond or t.k = '%}}' and s.tag in ('if', 'elif'),
      'error', coalesce(s.error, if({wrong}, s.line + if(t.k = '<stray>', t.nl, 0), null)))"""


def inspect(source: str) -> Column:
    """Of a column of templates: declared (the paths read), loops (those that loops run over), has_loops, has_conditionals, findings
    (broken rules, sorted) and error (the paragraph, a line each, of the first error)."""
    free = lambda paths: f"array_sort(array_distinct(filter({paths}, p -> array_contains(s.free, split(p, r'[.\\[]', 2)[0]))))"
    out = f"""named_struct('declared', {free('s.paths')}, 'loops', {free('s.loops')}, 'has_loops', s.loop, 'has_conditionals', s.cond,
      'findings', array_sort(array_distinct(s.found)), 'error', coalesce(s.error, if(size(s.blocks) > 1, s.line, null)))"""
    said = f"transform(array({source}), text -> {_words('text')})[0]"
    said = f"transform(array({said}), words -> {_kinds('words')})[0]"
    said = f"aggregate({said}, {_EMPTY}, (s, t) -> {_step()}, s -> {out})"
    return F.expr(f"if({source} is null, null, {said})")


def once_per_text(rows: DataFrame, texts: list[str], name: str, read: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows with a column that read() adds to the texts it is worked out from. Each different text, or row of texts, is read once, as many
    rows have the same; null texts are one like any other. Texts are few bytes for the work they make, so they are spread by number."""
    each = rows.select(*texts).distinct().repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    told = read(each).select(F.struct(*texts).alias("_texts"), name)
    return rows.withColumn("_texts", F.struct(*texts)).join(told, "_texts").drop("_texts")
