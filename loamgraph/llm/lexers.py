"""Lexers with a pushdown stack, and shape checks on what they give, for seven languages.

`fault(text, language)` names what is wrong with a source text, or gives None. Three stages:

1. The lexer reads literals, comments, names, numbers and operators of the language. Brackets, and
   string templates that hold code, go on one stack. Unterminated literals and comments, characters
   that the language has no use for, merge-conflict markers in code, a closing bracket that doesn't
   match, and an end of text with a non-empty stack are found here.
2. The bracketed tree is walked with an operand/operator automaton: two operands side by side,
   operators without operand, statements that begin or end as none can.
3. The outermost level, and class bodies, must be made of the declarations that the language has there.
   That tells texts of other languages, prose and markup.

What the lexer finds wrong in a Python text is wrong; texts that pass it are then confirmed by Python's own parser.
"""

import re
import warnings

from loamgraph.sources.lexers import CLOSES, EXTENSIONS, MARK, Bad, lex, tree  # noqa: F401

# ---------------------------------------------------------------- operands and operators

#: Reserved words that begin, join or end clauses and never stand for a value.
_RESERVED = {
    "java": "abstract assert break case catch class continue default do else enum extends final finally for goto if implements import instanceof interface native new package private protected public return static strictfp synchronized throw throws transient try volatile while",
    "kotlin": "as break class continue do else for fun if in interface is object package return throw try typealias val var when while",
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    "rust": "as async await break const continue dyn else enum extern fn for if impl in let loop match mod move mut pub ref return static struct trait type unsafe use where while",
    "javascript": "await break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return static switch throw try typeof var void while with yield let async of get set as from",
}
_RESERVED["typescript"] = _RESERVED["javascript"] + " type interface declare abstract readonly keyof is asserts infer satisfies namespace module enum private public protected override implements unique out accessor global"
_SOFT = {
    "java": "record sealed permits yield when var open module requires exports opens uses provides to with transitive non",
    "kotlin": "by catch constructor finally get import init set where abstract annotation companion const crossinline data enum expect external final infix inline inner internal lateinit noinline open operator out override private protected public reified sealed suspend tailrec vararg value actual field it",
    "go": "",
    "rust": "union macro_rules default auto raw self Self crate super",
    "javascript": "",
    "typescript": "",
}
_RESERVED = {k: frozenset(v.split()) for k, v in _RESERVED.items()}
_SOFT = {k: frozenset(v.split()) for k, v in _SOFT.items()}
_VALUES = {"return", "break", "continue", "super", "this", "self", "class", "default", "await", "it", "field", "object", "Self", "crate", "fallthrough", "get", "set", "of", "as", "from", "async", "type", "is", "module", "static", "global", "out", "let", "yield", "var", "when", "to", "with", "open", "record", "value", "data", "union", "auto", "raw", "throw", "import", "catch", "constructor", "init", "enum", "inner", "private", "public", "debugger", "else", "try", "finally", "do", "new", "inline", "namespace", "declare"}
_STATEMENT_STARTS = frozenset("for while if return switch try do throw break continue import package".split())
_STRICT = frozenset("+ - / % == != === !== <= >= && || += -= *= /= %= = . ?. ?? ^ << ** := &= |= ^= <<= ?: &^".split())
_PREFIX = {
    "java": "+ - ! ~ ++ -- @ <",
    "kotlin": "+ - ! ++ -- @ * :: < ->",
    "go": "+ - ! ~ ^ & && * ** <- ...",
    "rust": "- ! & && * ** < << .. ..= | || :: # $ ? ...",
    "javascript": "+ - ! ~ ++ -- ... < * **",
}
_PREFIX["typescript"] = _PREFIX["javascript"] + " @ | & << ? -"
_PREFIX = {k: frozenset(v.split()) for k, v in _PREFIX.items()}
_NEWLINE_ENDS = {"kotlin", "go", "javascript", "typescript"}


def _operand(item: tuple, language: str) -> bool:
    return item[0] in "ns" or (item[0] == "w" and item[1] not in _RESERVED[language] and item[1] not in _SOFT[language])


def walk(items: list[tuple], language: str, around: str) -> None:
    """The operand/operator automaton over one level, then over the levels inside. around: the bracket, or top."""
    reserved, prefix = _RESERVED[language], _PREFIX[language]
    newline_ends = language == "go" or (language in _NEWLINE_ENDS and around in ("{", "top"))
    last = None
    for i, item in enumerate(items):
        kind, t, fresh = item
        after = items[i + 1] if i + 1 < len(items) else None
        starts = last is None or (last[0] == "o" and last[1] == ";")
        if kind == "o":
            if t in _STRICT and t not in prefix:
                if starts and not (t == "." and around != "top" and last is None and language == "kotlin"):
                    raise Bad("unexpected_token")
                if last[0] == "o" and last[1] in _STRICT:
                    raise Bad("unexpected_token")
            if t in _STRICT:
                if after is None or (after[0] == "o" and after[1] in (";", ",")):
                    raise Bad("unexpected_token" if after is not None else "premature_end")
                if after[0] == "o" and after[1] in _STRICT and after[1] not in prefix:
                    raise Bad("unexpected_token")
                if t in (".", "?.") and not (after[0] == "w" or (after[0] == "o" and after[1] in ("*", "<", "@", "::", ":")) or after[0] in "([{" or (after[0] == "n" and language == "rust")):
                    raise Bad("unexpected_token")
            if t == "@" and not (after and (after[0] == "w" or after[0] in "([")):
                raise Bad("unexpected_token")
            if t == "#" and language == "rust" and not (after and (after[0] == "[" or after[0] in "{(w" or (after[0] == "o" and after[1] in ("!", "*", "?", "$")))):
                raise Bad("unexpected_token")
            if t == "," and (starts or (last[0] == "o" and last[1] == "," and not (around == "[" and language in ("javascript", "typescript")))) and not (around == "[" and language in ("javascript", "typescript")):
                raise Bad("unexpected_token")
        elif last is not None and _operand(item, language):
            beside = _operand(last, language)
            if beside and not (fresh and newline_ends):
                if kind in "ns" or last[0] in "ns":
                    # a number or literal beside another operand
                    if not (language == "kotlin" and kind == "w" and after and (_operand(after, language) or after[0] in "(\"")) and not (language == "kotlin" and last[0] == "w" and i >= 2 and (_operand(items[i - 2], language) or items[i - 2][0] in "([")) and not (
                        language == "go" and kind == "s" and around in ("{", "(") and last[0] == "w"
                    ) and not (language == "rust" and around in ("(", "[", "{") and i and _in_macro(items, i)):
                        raise Bad("unexpected_token")
                elif language in ("javascript", "typescript", "rust"):
                    raise Bad("unexpected_token")
                elif language == "java":
                    before = items[i - 2] if i >= 2 else None
                    if before is not None and _operand(before, language) and not before[2] is None and before[0] == "w":
                        raise Bad("unexpected_token")
                    if after is not None and not (after[0] == "o" and after[1] in ("=", ";", ",", ":", "->", "&&", "||", "...") or after[0] in "([{"):
                        raise Bad("unexpected_token")
                elif language == "go":
                    before = items[i - 2] if i >= 2 else None
                    if before is not None and _operand(before, language) and not last[2]:
                        raise Bad("unexpected_token")
                    if around == "{" and last[2] and after is not None and after[0] == "w" and not after[2]:
                        raise Bad("unexpected_token")
        elif last is not None and kind == "w" and t in _STATEMENT_STARTS and _operand(last, language) and language in ("java", "rust", "go", "kotlin", "javascript", "typescript"):
            if not (fresh and newline_ends) and not (t == "if" and language in ("rust", "kotlin", "go")) and not (language == "rust" and t == "for") and not (t == "import" and around != "top") and t != "package":
                raise Bad("unexpected_token")
        if kind in "([{":
            walk(t, language, kind)
        if kind == "{" and t and language == "java" and last is not None and (last[0] == "(" or last[:2] in (("o", "->"), ("w", "else"), ("w", "try"), ("w", "do"), ("w", "finally"))):
            if not (t[-1][0] == "{" or (t[-1][0] == "o" and t[-1][1] in (";", ":"))):
                raise Bad("unexpected_token")
        last = item
    if around == "{" and language == "java":
        _java_block(items)


def _in_macro(items: list[tuple], i: int) -> bool:
    return any(x[0] == "o" and x[1] in ("!", "$", "=>") for x in items)


def _java_block(items: list[tuple]) -> None:
    """A block with statements must end in one that is closed; a list of values must not hold any."""
    if not items:
        return
    has_end = any(x[0] == "o" and x[1] == ";" for x in items)
    last = items[-1]
    if has_end and not (last[0] == "{" or (last[0] == "o" and last[1] == ";")):
        raise Bad("premature_end")


# ---------------------------------------------------------------- declarations

_MODS = {
    "java": "public private protected static final abstract native synchronized transient volatile strictfp default sealed",
    "kotlin": "public private protected internal abstract final open sealed data inner enum annotation value inline infix operator suspend tailrec external const lateinit override companion vararg noinline crossinline reified expect actual fun",
    "rust": "pub unsafe async extern const default",
}
_MODS = {k: frozenset(v.split()) for k, v in _MODS.items()}


def _symbols(items: list[tuple], keep: frozenset) -> str:
    """Items as one symbol each, parted by blanks: kept words and operators as they are, else w n s l and ( [ {."""
    return " ".join((t if t in keep else "w") if k == "w" else t if k == "o" else k for k, t, _ in items) + " "


_TYPE_J = r"(?:@ w (?:\. w )*(?:\( )?)*w (?:G )?(?:\. (?:@ w )*w (?:G )?)*(?:\[ )*(?:\.\.\. )?"
_ANN = r"(?:@ w (?:\. w )*(?:\( )?)"
_J_KEEP = frozenset("package import static class interface enum record extends super throws default implements permits non sealed abstract final public private protected native synchronized transient volatile strictfp module open".split())
_J_MOD = r"(?:" + _ANN + r"|(?:public|private|protected|static|final|abstract|native|synchronized|transient|volatile|strictfp|default|sealed) |non - sealed )*"
_J_NAME = r"(?:w|record|permits|sealed|module|open|non) "
_J_MEMBER = re.compile(
    r"(?:; |package w (?:\. w )*; |import (?:static )?(?:module )?w (?:\. w )*(?:\. \* )?; |"
    + _J_MOD
    + r"(?:(?:class|interface|enum|record|@ interface) "
    + _J_NAME
    + r"(?:G )?(?:\( )?(?:(?:extends|implements|permits) "
    + _TYPE_J
    + r"(?:, "
    + _TYPE_J
    + r")*)*{ |(?:G )?(?:"
    + _TYPE_J
    + r")?(?:w|record|permits|open|module) (?:\( )?(?:\[ )*(?:throws "
    + _TYPE_J
    + r"(?:, "
    + _TYPE_J
    + r")*)?(?:default [^;]*)?(?:{ |; )|"
    + _TYPE_J
    + r"w (?:\[ )*(?:= [^;]*|, [^;]*)?; |{ )|(?:open )?module w (?:\. w )*{ )"
)
_J_GENERIC = re.compile(r"< (?:(?:w |\. |, |\? |& |\[ |G |extends |super |@ |\( )*)>")


def _collapse(symbols: str) -> str:
    """Type arguments as one symbol G, from the inside out."""
    symbols = symbols.replace(">>> ", "> > > ").replace(">> ", "> > ")
    while True:
        s = _J_GENERIC.sub("G", symbols)
        if s == symbols:
            return s
        symbols = s


def _java_members(items: list[tuple], inside: str) -> None:
    if inside == "enum":
        cut = next((i for i, x in enumerate(items) if x[0] == "o" and x[1] == ";"), len(items))
        items = items[cut + 1 :]
    if not items:
        return
    if inside == "top" and any(k == "{" and (i == 0 or items[i - 1][0] == "{" or items[i - 1][:2] in (("o", ";"), ("w", "static"))) for i, (k, _, _) in enumerate(items)):
        raise Bad("foreign_declaration")  # initializers stand in classes only
    s = _collapse(_symbols(items, _J_KEEP))
    at = 0
    while at < len(s):
        m = _J_MEMBER.match(s, at)
        if not m or m.end() == at:
            raise Bad("foreign_declaration")
        at = m.end()
    kind = None
    for k, t, _ in items:
        if k == "w" and t in ("class", "interface", "enum", "record"):
            kind = t if kind is None or t != "record" else kind
        elif k == "o" and t == ";":
            kind = None
        elif k == "{":
            if kind:
                _java_members(t, kind)
            kind = None
        elif k == "(" and kind not in ("record", None):
            kind = None


_K_TOP = frozenset("package import fun val var class interface object typealias".split())


_K_MEMBER = _K_TOP | {"init", "constructor"}


def _kotlin_top(items: list[tuple], inside: bool = False) -> None:
    i, n = 0, len(items)
    heads = _K_MEMBER if inside else _K_TOP
    while i < n:
        k, t, fresh = items[i]
        if k == "o" and t == ";":
            i += 1
            continue
        if not inside and not fresh and i and items[i - 1][0] == "{":
            raise Bad("foreign_declaration")
        begin = i
        # annotations and modifiers
        while i < n and ((items[i][0] == "o" and items[i][1] == "@") or (items[i][0] == "w" and items[i][1] in _MODS["kotlin"] and items[i][1] != "fun") or (items[i][0] == "w" and i and items[i - 1][0] == "o" and items[i - 1][1] in ("@", ".", ":")) or (items[i][0] == "o" and items[i][1] in (".", ":")) or items[i][0] in "(["):
            i += 1
        if i >= n or items[i][0] != "w" or items[i][1] not in heads:
            raise Bad("foreign_declaration")
        head = items[i][1]
        j = i + 1
        if j >= n or (head in ("package", "import", "val", "var", "class", "interface", "typealias") and items[j][0] not in ("w", "o", "(")) or items[j][0] in "ns":
            raise Bad("foreign_declaration")
        if head in ("package", "import"):
            while j < n and not items[j][2] and not (items[j][0] == "o" and items[j][1] == ";"):
                if not (items[j][0] == "w" or (items[j][0] == "o" and items[j][1] in (".", "*"))):
                    raise Bad("foreign_declaration")
                if items[j][0] == "w" and items[j - 1][0] == "w" and j - 1 > i and "as" not in (items[j][1], items[j - 1][1]):
                    raise Bad("foreign_declaration")
                j += 1
            i = j
            continue
        # to the next item that begins a line with a declaration word, at this level
        body = False
        while j < n:
            x = items[j]
            if x[0] == "{" and head in ("class", "interface", "object") and not body and not any(y[:2] == ("w", "enum") for y in items[begin:i]):
                _kotlin_top(x[1], True)
            if x[2] and x[0] == "w" and (x[1] in heads or x[1] in _MODS["kotlin"]) and not (items[j - 1][0] == "o" and items[j - 1][1] not in (";", ">")):
                break
            if x[2] and x[0] == "o" and x[1] == "@":
                break
            if x[0] == "o" and x[1] == ";":
                break
            if body and x[0] == "w" and head in ("fun", "class", "interface", "object") and items[j - 1][0] == "{":
                raise Bad("foreign_declaration")
            body = body or x[0] == "{"
            j += 1
        i = j


_G_DECL = frozenset("func type var const import".split())


def _go_top(items: list[tuple]) -> None:
    if len(items) < 2 or items[0][:2] != ("w", "package") or items[1][0] != "w" or items[1][2]:
        raise Bad("foreign_declaration")
    i, n = 2, len(items)
    while i < n:
        k, t, fresh = items[i]
        if k == "o" and t == ";":
            i += 1
            continue
        if not (k == "w" and t in _G_DECL and (fresh or items[i - 1][:2] == ("o", ";"))):
            raise Bad("foreign_declaration")
        if i + 1 >= n or (items[i + 1][0] not in ("w", "(", "s") and not (items[i + 1][0] == "o" and items[i + 1][1] == ".")) or (items[i + 1][2] and items[i + 1][0] == "w" and items[i + 1][1] in _G_DECL):
            raise Bad("foreign_declaration")
        if t == "func" and items[i + 1][0] == "(" and (i + 3 >= n or items[i + 2][0] != "w" or items[i + 3][0] not in ("(", "[")):
            raise Bad("foreign_declaration")
        if t == "func" and items[i + 1][0] == "w" and (i + 2 >= n or items[i + 2][0] not in ("(", "[")):
            raise Bad("foreign_declaration")
        j = i + 1
        while j < n and not (items[j][2] and items[j][0] == "w" and items[j][1] in _G_DECL and not (items[j - 1][0] == "o" and items[j - 1][1] != ";")):
            x = items[j]
            if x[2] and j > i + 1 and not (items[j - 1][0] == "o" and items[j - 1][1] not in (";", "++", "--")) and not (x[0] == "o" and x[1] == ";"):
                raise Bad("foreign_declaration")
            if t == "func" and items[j - 1][0] == "{" and x[0] not in ("(", "o") and j - 1 > i:
                prev = items[j - 2]
                if not (prev[0] == "w" and prev[1] in ("struct", "interface")):
                    raise Bad("foreign_declaration")
            j += 1
        i = j


_R_ITEM = frozenset("use fn struct enum impl trait mod static const type extern macro_rules union".split())


def _rust_items(items: list[tuple]) -> None:
    i, n = 0, len(items)
    while i < n:
        k, t, _ = items[i]
        if k == "o" and t == ";":
            i += 1
            continue
        while i < n and items[i][0] == "o" and items[i][1] == "#":
            i += 1 + (i + 1 < n and items[i + 1][:2] == ("o", "!"))
            if i >= n or items[i][0] != "[":
                raise Bad("foreign_declaration")
            i += 1
        if i >= n:
            break
        while i < n and items[i][0] == "w" and items[i][1] in _MODS["rust"] and not (items[i][1] in ("const",) and i + 1 < n and items[i + 1][0] == "w" and items[i + 1][1] not in ("fn", "unsafe", "async", "extern")):
            i += 1
            if i < n and items[i][0] in "(s":
                i += 1
        if i < n and items[i][0] == "{" and items[i - 1][1] in ("extern",):
            i += 1
            continue
        if i < n and items[i][0] == "s" and items[i - 1][1] == "extern":
            i += 1
            continue
        if i + 1 >= n or items[i][0] != "w":
            raise Bad("foreign_declaration")
        head = items[i][1]
        if head not in _R_ITEM:
            # a macro call
            j = i
            while j + 2 < n and items[j + 1][:2] == ("o", "::"):
                j += 2
            if j + 2 < n + 0 and items[j + 1][:2] == ("o", "!") and j + 2 < n and items[j + 2][0] in "([{":
                i = j + 3
                continue
            raise Bad("foreign_declaration")
        if head not in ("impl", "macro_rules", "extern", "use") and items[i + 1][0] != "w":
            raise Bad("foreign_declaration")
        j = i + 1
        while j < n and not (items[j][0] == "o" and items[j][1] == ";") and not (items[j][0] == "{" and head not in ("use", "static", "const", "type")):
            if j > i + 1 and head in ("fn", "struct", "enum", "mod", "use") and items[j][0] == "w" and items[j][1] in ("fn", "struct", "enum", "mod", "use", "impl", "pub") and items[j][2]:
                raise Bad("premature_end")
            j += 1
        if j >= n:
            raise Bad("premature_end")
        if head in ("impl", "trait", "mod") and items[j][0] == "{":
            _rust_items(items[j][1])
        i = j + 1


_E_CLASS = frozenset(("class",))


def _ecma(items: list[tuple], language: str, around: str) -> None:
    """Forms that only TypeScript has, labels, imports, and class bodies."""
    n = len(items)
    for i, (k, t, fresh) in enumerate(items):
        last, after = items[i - 1] if i else None, items[i + 1] if i + 1 < n else None
        if k == "w" and t == "class" and not (last and last[0] == "o" and last[1] in (".", "?.")):
            j = i + 1
            while j < n and items[j][0] != "{" and not (items[j][0] == "o" and items[j][1] in (";", ",", "=", ":")):
                j += 1
            if j < n and items[j][0] == "{":
                _ecma_class(items[j][1], language)
            elif j >= n and i + 1 < n and items[i + 1][0] == "w":
                raise Bad("premature_end")
        if k == "w" and t == "import" and around == "top" and not (after and (after[0] == "(" or after[:2] == ("o", "."))):
            j = i + 1
            while j < n and items[j][0] != "s" and not (items[j][0] == "o" and items[j][1] in (";", "=")):
                j += 1
            if j >= n or not (items[j][0] == "s" or (items[j][1] == "=" and language == "typescript")) or (j > i + 1 and items[j][0] == "s" and items[j - 1][:2] != ("w", "from")):
                raise Bad("foreign_declaration")
        if k == "o" and t == ":" and around in ("top", "block") and last is not None and last[0] in "ns" and (i < 2 or (items[i - 2][0] == "o" and items[i - 2][1] == ";")):
            raise Bad("unexpected_token")
        if k == "{":
            block = around in ("top", "block", "body") and (last is None or last[0] in "(" or (last[0] == "o" and last[1] in (";", "=>")) or (last[0] == "w" and last[1] in ("else", "do", "try", "finally")) or last[0] == "{" or (fresh and around in ("top", "block") and last[0] != "o"))
            head = next((items[q][1] for q in range(i - 1, -1, -1) if items[q][0] == "w" and items[q][1] in ("class", "interface", "enum", "type", "switch", "import", "export", "namespace")), None) if around in ("top", "block") else None
            _ecma(t, language, "block" if block and head not in ("interface", "enum", "type", "switch", "import") else "other")
        elif k == "(":
            if language == "javascript" and any(x[0] == "o" and x[1] == ":" for x in t) and not any(x[0] == "o" and x[1] in ("?",) for x in t):
                raise Bad("unexpected_token")
            _ecma(t, language, "other")
        elif k == "[":
            _ecma(t, language, "other")
    if around in ("top", "block") and items and items[0][0] == "s" and len(items) > 1 and items[1][:2] == ("o", ":"):
        raise Bad("unexpected_token")


def _ecma_class(items: list[tuple], language: str) -> None:
    i, n = 0, len(items)
    while i < n:
        k, t, fresh = items[i]
        if k == "o" and t in (";", "*"):
            i += 1
            continue
        if k == "o" and t == "@" and language == "typescript":
            i += 2
            while i < n and (items[i][0] == "(" or items[i][:2] == ("o", ".") or (items[i][0] == "w" and items[i - 1][:2] == ("o", "."))):
                i += 1
            continue
        if k not in ("w", "s", "n", "[", "{") or (k == "{" and not (i and items[i - 1][:2] == ("w", "static"))):
            raise Bad("foreign_declaration")
        if k == "{":
            i += 1
            continue
        j = i + 1
        while j < n and items[j][0] in ("w", "[", "s", "n") and items[j - 1][0] == "w" and not items[j][2]:
            if items[j - 1][1] not in _RESERVED[language]:
                raise Bad("foreign_declaration")
            j += 1
        if j < n and items[j][:2] == ("o", "*"):
            i = j
            continue
        if j < n and items[j][0] == "o" and items[j][1] in ("?", "!") and language == "typescript":
            j += 1
        if j < n and items[j][:2] == ("o", "<") and language == "typescript":
            while j < n and items[j][0] != "(":
                j += 1
        if j < n and items[j][0] == "(":
            j += 1
            if language == "typescript":
                if j < n and items[j][:2] == ("o", ":"):
                    j += 1
                    while j < n and not (items[j][0] == "{" and not (items[j - 1][0] == "o" and items[j - 1][1] in (":", "|", "&", "<", ","))) and not (items[j][:2] == ("o", ";")) and not (items[j][2] and items[j][0] == "w" and items[j - 1][0] != "o"):
                        j += 1
                i = j + 1 if j < n and (items[j][0] == "{" or items[j][:2] == ("o", ";")) else j
                continue
            if j >= n or items[j][0] != "{":
                raise Bad("foreign_declaration")
            i = j + 1
            continue
        if j < n and items[j][0] == "{" and items[j - 1][:2] == ("w", "static"):
            i = j + 1
            continue
        # a field: to its semicolon, or to a line that begins another member
        if j < n and not items[j][2] and not (items[j][0] == "o" and (items[j][1] in ("=", ";") or (items[j][1] == ":" and language == "typescript"))):
            raise Bad("foreign_declaration")
        while j < n and items[j][:2] != ("o", ";") and not (items[j][2] and items[j][0] in ("w", "[", "s") and items[j - 1][0] != "o"):
            j += 1
        i = j


# ---------------------------------------------------------------- Python


_PY = re.compile(
    r"(?P<blank>[ \t\f]+)|(?P<end>\r\n|\r|\n)|(?P<rest>#[^\r\n]*+)|(?P<join>\\(?:\r\n|\r|\n))|(?P<text>(?i:[rbuft]{0,2})(?:\'\'\'|\"\"\"|\'|\"))|(?P<word>\w+)|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<other>[\s\S])"
)
_INDENT = re.compile(r"[ \t\f]*+")
_PY_PLAIN = {q: re.compile(rf"(?:[^{q[0]}\\" + ("" if len(q) == 3 else r"\r\n") + r"]|\\(?:\r\n|[\s\S])" + (rf"|{q[0]}(?!{q[0] * 2})" if len(q) == 3 else "") + rf")*+{q}") for q in ("'", '"', "'''", '"""')}
_PY_FIELDS = {q: re.compile(rf"(?:[^{q[0]}\\{{}}" + ("" if len(q) == 3 else r"\r\n") + r"]|\{\{|\}\}|\\(?:N\{[A-Za-z0-9 -]+\}|\r\n|(?![{}])[\s\S]|(?=[{}]))" + (rf"|{q[0]}(?!{q[0] * 2})" if len(q) == 3 else "") + r")*+") for q in ("'", '"', "'''", '"""')}
_PY_SPEC = re.compile(r"[^{}]*+")


def _python(text: str) -> None:
    """Brackets, literals, the fields of string templates and indentation, all on one stack."""
    text = text.removeprefix("﻿")
    i, n, stack, depths, start = 0, len(text), [], [0], True

    def fields(i: int, quote: str) -> int:
        """On from inside a template: behind its end, or behind the brace that opens a field."""
        i = _PY_FIELDS[quote].match(text, i).end()
        if text.startswith(quote, i):
            return i + len(quote)
        if text.startswith("{", i):
            stack.append("f" + quote)
            return i + 1
        raise Bad("unexpected_token" if text.startswith("}", i) else "unterminated_literal")

    def spec(i: int) -> int:
        """On in the format of a field: behind the brace that opens a field in it, or to the one that ends it."""
        i = _PY_SPEC.match(text, i).end()
        if text.startswith("{", i):
            stack.append("s")
            return i + 1
        if i >= n:
            raise Bad("unterminated_literal")
        return i

    while i < n:
        if start and not stack:
            m = _INDENT.match(text, i)
            rest = text[m.end() : m.end() + 1]
            if MARK.match(text, i):
                raise Bad("conflict_marker")
            if rest and rest not in "#\r\n":
                width = len(m[0].expandtabs(8))
                if width > depths[-1]:
                    depths.append(width)
                while width < depths[-1]:
                    depths.pop()
                if width != depths[-1]:
                    raise Bad("unexpected_indent")
            i, start = m.end(), False
            if i >= n:
                break
        m = _PY.match(text, i)
        kind, i = m.lastgroup, m.end()
        if kind == "end":
            start = True
        elif kind == "text":
            quote = m[0].lstrip("rRbBuUfFtT")
            if "f" in m[0].lower() or "t" in m[0].lower():
                i = fields(i, quote)
            else:
                m = _PY_PLAIN[quote].match(text, i)
                if not m:
                    raise Bad("unterminated_literal")
                i = m.end()
        elif kind == "open":
            stack.append(m[0])
        elif kind == "close":
            if not stack:
                raise Bad("unbalanced")
            opened = stack.pop()
            if opened[0] == "f" and m[0] == "}":
                i = fields(i, opened[1:])
            elif opened == "s" and m[0] == "}":
                i = spec(i)
            elif opened != CLOSES[m[0]]:
                raise Bad("unbalanced")
        elif kind == "other" and m[0] == ":" and stack and stack[-1][0] in "fs":
            i = spec(i)
    if stack:
        raise Bad("premature_end")


def _python_parses(text: str) -> bool:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            compile(text, "<file>", "exec", dont_inherit=True)
        return True
    except (SyntaxError, ValueError):
        return False
    except (RecursionError, MemoryError, OverflowError):
        # too deep for this parser; the lexer found nothing
        return True


def fault(text: str | None, language: str) -> str | None:
    """What is wrong with the text in that language; None for a valid text and for null."""
    if text is None:
        return None
    try:
        if language == "python":
            _python(text)
            return None if _python_parses(text) else "unexpected_token"
        text = text.removeprefix("﻿")
        items = tree(lex(text, language))
        walk(items, language, "top")
        if language == "java":
            _java_members(items, "top")
        elif language == "kotlin":
            _kotlin_top(items)
        elif language == "go":
            _go_top(items)
        elif language == "rust":
            _rust_items(items)
        else:
            _ecma(items, language, "top")
    except Bad as bad:
        return str(bad)
    except RecursionError:
        return None
    return None
