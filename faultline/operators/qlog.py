"""Bulk lexical scan of query texts.

Every statement is cut into tokens by one regular expression; literals are
replaced by a mark and comments dropped, so statements that differ only in
their constants share one *shape*.  Shapes are de-duplicated (with map-side
combine) and each is scanned once, inside its own row: paren depth and the
governing clause come from one fold over the token classes, table references,
column references and projections from the tokens next to them.  No token is
ever shuffled.

A statement that writes (`INSERT ... SELECT`, `CREATE TABLE / VIEW ... AS SELECT`)
is its head, which gives a target, and a query that is scanned like any other.

Text outside the supported grammar is marked `assessable = false`; nothing is
then claimed about it.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import expr as X

_PART = r'(?:[\p{L}_][\p{L}\p{N}_$]*+|"[^"]++"|`[^`]++`)'
_TOKEN = (
    r"'(?:[^'\\]++|\\.|'')*+'"                                    # string literal
    r"|--[^\n]*+|/\*(?s:.*?)\*/"                                   # comment
    r"|(?i:\b(?:group\s+by|order\s+by|partition\s+by|distinct\s+from|within\s+group"
    r"|nulls\s+(?:first|last)|(?:ignore|respect)\s+nulls|at\s+time\s+zone)\b)"
    r"|" + _PART + r"(?:\s*+\.\s*+" + _PART + r")*+(?:\s*+\.\s*+\*)?"  # name, name.*
    r"|[0-9][A-Za-z0-9_.]*+|\.[0-9]++"                             # number
    r"|::|=>|<=|>=|<>|!=|\|\||/\*|//|\$\$|\s++|\S"
)

KEYWORDS = (
    "select", "distinct", "all", "from", "where", "having", "qualify", "join", "inner", "left",
    "right", "full", "outer", "cross", "natural", "on", "using", "and", "or", "not", "in", "is",
    "null", "like", "ilike", "rlike", "regexp", "between", "exists", "case", "when", "then",
    "else", "end", "as", "limit", "offset", "fetch", "union", "except", "intersect", "minus",
    "with", "recursive", "over", "true", "false", "interval", "lateral", "window", "any", "some",
    "escape", "group", "order", "asc", "desc", "group by", "order by", "partition by",
    "distinct from", "within group", "nulls first", "nulls last", "ignore nulls",
    "respect nulls", "at time zone",
)
# Token -> class letter used by the clause fold; every other token is '-'.
_CLASSES = {
    "(": "(", ")": ")", ",": ",", "select": "s", "from": "f", "join": "n", "on": "j",
    "using": "j", "where": "w", "group by": "g", "having": "h", "order by": "o", "qualify": "q",
    "window": "x",
}
# Clause letter -> clause name; upper case means taken over from the enclosing level.
CLAUSES = {"s": "select", "f": "select", "x": "select", "n": "join", "j": "join", "w": "where",
           "g": "group", "h": "having", "o": "order", "q": "qualify"}
# Words whose presence makes a statement unsupported.
_UNSUPPORTED = ("pivot", "unpivot", "match_recognize", "connect", "group", "order")
# Functions whose first argument may be a bare date unit.
_UNIT_FUNCTIONS = ("dateadd", "datediff", "date_add", "date_diff", "date_part", "date_trunc",
                   "extract", "timestampadd", "timestampdiff", "timestamp_trunc", "timeadd",
                   "timediff", "trunc")
# Functions that may stand for a table: their arguments are values, never table names.
_ROW_FUNCTIONS = ("unnest", "flatten", "explode", "generate_series", "sequence", "range")
_TYPED_LITERALS = ("date", "time", "timestamp", "timestamptz", "datetime", "interval")
# Heads of statements that write what a query reads, over tokens joined by spaces.
_NAME = r"([^\s(),;]+)"
_LISTED = r"( \( [^\s(),;]+(?: , [^\s(),;]+)* \))?"
_QUERY = r" (?=(?:select|with|\() )"
_INSERT = r"^insert (?:into|overwrite)(?: table)? " + _NAME + _LISTED + _QUERY
_CREATE = (r"^create(?: or replace)?(?: temp| temporary| transient)?(?: materialized| recursive)?"
           r"(?: table| view)(?: if not exists)? " + _NAME + _LISTED + r" as" + _QUERY)
_STAR_MODIFIERS = ("exclude", "except", "rename", "replace", "ilike")
MAX_DEPTH = 60


def _words(values) -> str:
    return ", ".join("'" + v + "'" for v in values)


def raw_tokens(sql: Column | str) -> Column:
    """Every token, white space and comments included: joined they give the text back."""
    return F.regexp_extract_all(X.col(sql), F.lit(_TOKEN), F.lit(0))


def shape_tokens(sql: Column | str) -> Column:
    """Tokens without white space and comments, literals and numbers replaced by marks."""
    kept = F.filter(raw_tokens(sql), lambda t: ~(
        t.rlike(r"^\s") | t.startswith("--")
        | (t.startswith("/*") & (F.length(t) > 2))))
    return F.transform(kept, lambda t: F.when(t.startswith("'") & (F.length(t) > 1), "'?'")
                       .when(t.rlike(r"^\.?[0-9]"), "0")
                       .otherwise(F.regexp_replace(t, r"\s+", " ")))


def plain_text(sql: Column | str) -> Column:
    """The text with constants blanked where that needs no tokens, so that repeated statements
    can be grouped before they are tokenised.  Text with quoted names, comments or escapes is
    left alone."""
    text = X.col(sql)
    # plain searches, and a digit looked for before what stands left of it: every row comes by here
    simple = ~reduce(or_, (F.contains(text, F.lit(x)) for x in ('"', "`", "\\", "#", "--", "/*", "//", "$$")))
    unquoted = F.when(F.contains(text, F.lit("'")), F.regexp_replace(text, "'[^']*+'", "'?'")).otherwise(text)
    blank = F.regexp_replace(unquoted, r"(?=[0-9])(?<![\p{L}\p{N}_$])[0-9]++(?![\p{L}\p{N}_$])", "0")
    return F.when(simple, blank).otherwise(text)


def shape_list(sql: str) -> Column:
    return F.coalesce(shape_tokens(F.coalesce(F.col(sql), F.lit(""))), F.array().cast("array<string>"))


def shape_digest(tokens: Column | str) -> Column:
    return F.sha2(F.array_join(tokens, " "), 256)


def with_shape(queries: DataFrame, sql: str = "sql") -> DataFrame:
    """Adds `tokens` and `shape_id`, a digest of the normalised statement."""
    return queries.withColumn("tokens", shape_list(sql)).withColumn("shape_id", shape_digest("tokens"))


def text_id(sql: Column | str) -> Column:
    return F.sha2(F.coalesce(X.col(sql), F.lit("")), 256)


def with_known_shape(queries: DataFrame, texts: DataFrame, sql: str = "sql") -> DataFrame:
    """Adds `shape_id`, looked up by plain text in `texts(text_id, shape_id)`; only a statement
    that is not there is cut into tokens."""
    known = texts.select("text_id", F.col("shape_id").alias("known"))
    out = queries.withColumn("text_id", text_id(plain_text(sql))).join(known, "text_id", "left")
    return out.withColumn("shape_id", F.coalesce("known", shape_digest(shape_list(sql)))).drop("text_id", "known")


def distinct_shapes(shaped: DataFrame, keys: tuple[str, ...] = ("catalog",)) -> DataFrame:
    """One row per shape; copies of a popular shape meet before the shuffle."""
    return shaped.groupBy(*keys, "shape_id").agg(F.first("tokens").alias("tokens"))


# ---------------------------------------------------------------- the scan
def _kind_expr() -> str:
    """k keyword, i name, s qualified star, l literal, n number, p anything else."""
    return ("case when t in (" + _words(KEYWORDS) + ") then 'k' "
            "when t rlike '^[\\\\p{L}_\"`].*[.] ?[*]$' then 's' "
            "when t rlike '^([\\\\p{L}_]|\"..|`..)' then 'i' "
            "when t = '\\'?\\'' then 'l' when t = '0' then 'n' else 'p' end")


def _fold_expr() -> str:
    """`st` is the stack of clause letters, innermost first; `out` the letter that governs
    each token; `dep` its depth as a character."""
    top, rest = "left(a.st, 1)", "substr(a.st, 2)"
    step = f"""case
      when c = '-' then a.st
      when c = '(' then concat(upper({top}), a.st)
      when c = ')' then case when length(a.st) > 1 then {rest} else '' end
      when c = ',' then case when {top} in ('f', 'n', 'j') then concat('n', {rest}) else a.st end
      when c = 'f' and {top} <> 's' or c = 'j' and {top} not in ('f', 'n')
        or c = 'x' and {top} not in ('f', 'n', 'j', 'w', 'g', 'h') then a.st
      else concat(c, {rest}) end"""
    return f"""aggregate(classes, named_struct('st', 'X', 'out', '', 'dep', ''),
      (a, c) -> named_struct('st', {step},
        'out', concat(a.out, case when a.st = '' then '!' else {top} end),
        'dep', concat(a.dep, char(40 + least(length(a.st), 80)))))"""


# One struct per token with the neighbours the rules look at.
_WINDOW = """transform(low, (t, i) -> named_struct('i', i, 't', t,
  'k', substr(kinds, i + 1, 1), 'c', substr(fold.out, i + 1, 1),
  'd', ascii(substr(fold.dep, i + 1, 1)) - 40,
  'p', coalesce(get(low, i - 1), ''), 'p2', coalesce(get(low, i - 2), ''),
  'pk', case when i > 0 then substr(kinds, i, 1) else '' end,
  'n', coalesce(get(low, i + 1), ''), 'n2', coalesce(get(low, i + 2), ''),
  'n3', coalesce(get(low, i + 3), ''),
  'nk', substr(kinds, i + 2, 1), 'nk2', substr(kinds, i + 3, 1)))"""
_ENDS = "('', ',', 'from', ')', ';', 'union', 'except', 'intersect', 'minus', 'limit', 'where')"
_HEAD = "('select', 'distinct', 'all')"
_STARTS = "('select', 'distinct', 'all', ',')"
# The name parts of a token, quotes removed.
_PARTS = ("transform(regexp_extract_all(x.t, '(?:[^.\"`]++|\"[^\"]++\"|`[^`]++`)', 0),"
          " p -> trim(regexp_replace(p, '[\"`]', '')))")


def _unquoted(token: str) -> str:
    return f"regexp_replace({token}, '[\"`]', '')"


def _lex(rows: DataFrame) -> DataFrame:
    classes = "try_element_at(map({}), t)".format(
        ", ".join(f"'{k}', '{v}'" for k, v in _CLASSES.items()))
    d = rows.withColumn("low", F.transform("tokens", F.lower))
    d = d.withColumn("said", F.when(F.get("low", F.lit(0)).isin("insert", "create"), F.array_join("low", " ")))
    head = F.coalesce(F.nullif(F.regexp_extract("said", _INSERT, 0), F.lit("")),
                      F.regexp_extract("said", _CREATE, 0), F.lit(""))
    d = d.withColumn("head", F.when(head == "", 0).otherwise(F.size(F.split(F.btrim(head), " "))))
    d = d.withColumn("low", F.slice("low", F.col("head") + 1, F.size("low")))
    d = d.withColumns({
        "kinds": F.expr(f"array_join(transform(low, t -> {_kind_expr()}), '')"),
        "classes": F.expr(f"transform(low, t -> coalesce({classes}, '-'))")})
    d = d.withColumn("fold", F.expr(_fold_expr())).withColumn("tk", F.expr(_WINDOW))
    # A clause word may not be followed by another one, a closing paren or the end.
    # What stands in the place of a table must be a name, a subquery, a name in parentheses or a
    # function of values; an opening bracket must be a subscript.
    function = f"x.t in ({_words(_ROW_FUNCTIONS)})"
    bad_token = f"""x.c in ('f', 'n') and x.p in ('from', 'join', ',') and not (
        x.k = 'i' and (x.n <> '(' or {function}) and x.t <> 'only'
        or x.t = '(' and (x.n in ('select', 'with') or x.nk = 'i' and x.n2 <> '(' and x.n <> 'only')
        or x.t = 'lateral' and (x.n = '(' and x.n2 in ('select', 'with')
                                or x.n in ({_words(_ROW_FUNCTIONS)}) and x.n2 = '('))
      or x.t = '[' and not (x.pk = 'i' or x.p in (')', ']'))
      or x.t = 'apply' or x.k = 'p' and ascii(x.t) > 127
      or x.c = '!' or x.d > {MAX_DEPTH} or x.t = ';' and x.n <> ''
      or x.t in ('{{', '}}', '\\'', '"', '`', '/*', '//', '#', '$$', '\\\\', '!',
                 {_words(_UNSUPPORTED)})
      or x.t = 'distinct' and x.n = 'on' or x.t = 'top' and x.p in {_HEAD}
      or x.t = 'start' and x.n = 'with'
      or x.t in ('natural', '$') or x.t = 'table' and x.nk = 'i'
      or x.t = 'in' and x.nk = 'i' and x.n2 <> '('
      or x.t = 'columns' and x.n = '(' or x.t = 'u' and x.n = '&' and startswith(x.n2, '"')
      or x.t in ('select', 'from', 'join', 'on', 'using', 'where', 'group by', 'having',
                 'order by', 'qualify')
         and x.n in ('', ')', 'from', 'where', 'group by', 'having', 'order by', 'qualify',
                     'join', ';', ',')
         and not (x.t = 'from' and x.p in ('both', 'leading', 'trailing'))
      or x.t = '*' and x.p in {_HEAD} and x.nk in ('i', 'l', 'n')
         and x.n not in ({_words(_STAR_MODIFIERS)})"""
    return d.withColumn("assessable", F.expr(
        "size(low) > 0 and coalesce(get(low, 0), '') in ('select', 'with', '(')"
        " and array_contains(low, 'select') and fold.st rlike '^[a-zA-Z]$'"
        # three names in a row, or operands side by side, are no SQL
        f" and not kinds rlike 'iii|l[in]i|nn|ll' and not exists(tk, x -> {bad_token})"))


def readable(rows: DataFrame, tokens: Column, name: str) -> DataFrame:
    """Adds whether a statement can be assessed at all."""
    keep = list(rows.columns)
    return _lex(rows.withColumn("tokens", tokens)).select(*keep, F.col("assessable").alias(name))


def scan(shapes: DataFrame) -> DataFrame:
    """Adds to rows with `tokens`: assessable, sources, refs, readings, stars, projections, outputs,
    targets.

    sources      array<struct<depth, pos, name, alias>>  in resolution order
    refs         array<struct<pos, qualifier, name, clause>>
    readings     like refs: what else a dotted name may mean, as `a.b.c` may be field c of a.b
    stars        array<struct<depth, pos, qualifier>>    '' for a bare star; a name that is a
                 source itself stands for its whole row
    projections  array<struct<pos, len, depth, qualifier, name, output, sole>>
    outputs      array<string>: output names of the outermost first SELECT
    targets      array<struct<name, bare, listed, made>>: what the statement writes, at most one
    """
    keep = list(shapes.columns)
    d = _lex(shapes)
    in_list = "x.p in ('from', 'join', ',')"
    is_table = f"""(x.k = 'i' and x.n <> '(' and (x.c in ('f', 'n') and {in_list}
      or x.c in ('F', 'N') and x.p = '(' and x.p2 in ('from', 'join', ',')))"""
    after_operand = "(x.pk in ('i', 'l', 'n', 's') or x.p in (')', ']', 'end'))"
    is_name = f"""(x.k = 'i' and x.n not in ('(', '=>') and not {after_operand}
      and x.p not in ('as', '::', ':', 'over', 'window', 'collate')
      and not (x.t in ({_words(_TYPED_LITERALS)}) and x.nk = 'l')
      and not (x.n = 'as' and x.n2 = '(')
      and not (x.p = '(' and x.p2 in ({_words(_UNIT_FUNCTIONS)}) and x.n in (',', 'from'))
      and not {is_table})"""
    clauses = "try_element_at(map({}), lower(x.c))".format(
        ", ".join(f"'{k}', '{v}'" for k, v in CLAUSES.items()))
    alias = (f"case when x.n = 'as' and x.nk2 = 'i' then x.n2 when x.nk = 'i' then x.n"
             " else '' end")
    # The width of a projection that is one plain column, in tokens; 0 for anything else.
    width = (f"case when x.n in {_ENDS} then 1 when x.n = 'as' and x.n3 in {_ENDS} then 3"
             f" when x.nk = 'i' and x.n2 in {_ENDS} then 2 else 0 end")
    qualifier = "coalesce(try_element_at(q, -2), '')"

    def with_parts(rows: str, body: str) -> str:
        return (f"transform({rows}, x -> aggregate(array({_PARTS}), cast(null as {{}}),"
                f" (acc, q) -> {body}))")

    d = d.withColumn("sources", F.expr("array_sort(" + with_parts(
        f"filter(tk, x -> {is_table})", "named_struct('depth', x.d, 'pos', x.i + head, 'name', element_at(q, -1), 'alias', "
        f"{_unquoted(alias)})").format("struct<depth: int, pos: int, name: string, alias: string>")
        + ")"))
    d = d.withColumn("refs", F.expr(with_parts(
        f"filter(tk, x -> {is_name})", f"named_struct('pos', x.i + head, 'qualifier', {qualifier}, 'name', element_at(q, -1),"
        f" 'clause', coalesce({clauses}, 'select'))").format(
        "struct<pos: int, qualifier: string, name: string, clause: string>")))
    source = "exists(sources, s -> s.alias = {0} or s.name = {0})"
    reading = (f"named_struct('pos', x.i + head, 'qualifier', case when j = 0 then '' else q[j - 1] end,"
               f" 'name', q[j], 'clause', coalesce({clauses}, 'select'))")
    d = d.withColumn("readings", F.expr("flatten(" + with_parts(
        f"filter(tk, x -> {is_name} and contains(x.t, '.'))",
        f"transform(filter(sequence(0, greatest(size(q) - 2, 0)), j -> j < size(q) - 1 and (j > 0 or"
        f" not {source.format('q[0]')})), j -> {reading})").format(
        "array<struct<pos: int, qualifier: string, name: string, clause: string>>") + ")"))
    star = "struct<depth: int, pos: int, qualifier: string>"
    d = d.withColumn("stars", F.expr("array_sort(concat(" + with_parts(
        f"filter(tk, x -> x.c = 's' and x.p in {_STARTS} and (x.k = 's' or x.t = '*'))",
        "named_struct('depth', x.d, 'pos', x.i + head, 'qualifier',"
        f" case when x.t = '*' then '' else {qualifier} end)").format(star) + ", " + with_parts(
        f"filter(tk, x -> {is_name} and {source.format(_unquoted('x.t'))})",
        "named_struct('depth', x.d, 'pos', x.i + head, 'qualifier', element_at(q, -1))").format(star) + "))"))
    d = d.withColumn("projections", F.expr(with_parts(
        f"filter(tk, x -> x.k = 'i' and x.c = 's' and x.p in {_STARTS} and {width} > 0)",
        f"named_struct('pos', x.i + head, 'len', {width}, 'depth', x.d, 'qualifier', {qualifier},"
        " 'name', element_at(q, -1), 'output', case when x.n = 'as' then "
        f"{_unquoted('x.n2')} when x.nk = 'i' then {_unquoted('x.n')} else element_at(q, -1) end,"
        f" 'sole', x.p <> ',' and coalesce(get(low, x.i + {width}), '') <> ',')").format(
        "struct<pos: int, len: int, depth: int, qualifier: string, name: string, output: string,"
        " sole: boolean>")))
    d = d.withColumn("heads", F.expr(
        "array_sort(transform(filter(tk, x -> x.t = 'select'),"
        " x -> named_struct('d', x.d, 'i', x.i)))"))
    d = d.withColumn("outputs", F.expr(with_parts(
        f"""filter(tk, x -> x.k = 'i' and x.c = 's' and x.n in {_ENDS}
          and (x.p = 'as' or x.p in {_STARTS} or {after_operand})
          and x.d = heads[0].d and x.i > heads[0].i
          and not exists(heads, h -> h.d = heads[0].d and h.i > heads[0].i and h.i < x.i))""",
        "element_at(q, -1)").format("string")))
    def of_head(group: int) -> Column:
        both = (F.nullif(F.regexp_extract("said", p, group), F.lit("")) for p in (_INSERT, _CREATE))
        return F.regexp_replace(F.coalesce(*both, F.lit("")), '["`]', "")

    listed = F.filter(F.split(of_head(2), r"[ (),]+"), lambda c: c != "")
    target = F.struct(of_head(1).alias("name"), F.element_at(F.split(of_head(1), r"\."), -1).alias("bare"),
                      listed.alias("listed"), F.startswith("said", F.lit("create")).alias("made"))
    d = d.withColumn("targets", F.when(F.col("head") > 0, F.array(target)).otherwise(
        F.slice(F.array(target), 1, 0)))
    found = ("sources", "refs", "readings", "stars", "projections", "outputs", "targets")
    none = [F.when(F.col("assessable"), F.col(c)).otherwise(F.slice(F.col(c), 1, 0)).alias(c)
            for c in found]
    return d.select(*keep, "assessable", *none)
