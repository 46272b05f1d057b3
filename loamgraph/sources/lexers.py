"""Lexers with a pushdown stack for seven languages.

`lex` reads literals, comments, names, numbers and operators. Brackets, and string templates that hold code, go on one stack: unterminated literals
and comments, characters that a language has no use for, merge-conflict markers in code, a closing bracket that doesn't match, and an end of text with a non-empty stack
raise Bad. `tree` turns the tokens into nested brackets.
"""

import re

EXTENSIONS = {"java": "java", "kt": "kotlin", "py": "python", "go": "go", "rs": "rust", "ts": "typescript", "js": "javascript"}


class Bad(Exception):
    """What is wrong."""


MARK = re.compile(r"(?:<{7}|>{7}|\|{7}|={7})(?=[ \t\r\n]|$)")
_OPS = sorted(
    ">>>= ... === !== **= <<= >>= >>> &&= ||= ??= ..= ..< &^= -> => :: ?. ?: !! ++ -- && || ?? == != <= >= += -= *= /= %= &= |= ^= := <- &^ << >> ** ..".split(),
    key=len,
    reverse=True,
)
_OP = re.compile("|".join(map(re.escape, _OPS)) + r"|[-+*/%=<>!&|^~?:;,.@#$()\[\]{}\\]")
_WORD = {k: re.compile(r"[^\W\d][\w$]*|\$[\w$]*" if k in ("java", "javascript", "typescript") else r"[^\W\d]\w*") for k in EXTENSIONS.values()}
_NUM = {
    k: re.compile(r"0[xX][\da-fA-F_]+(?:\.[\da-fA-F_]*)?(?:[pP][+-]?\d+)?\w*|0[bBoO][\d_]+\w*|(?:\d[\d_]*(?:" + (r"\.(?![.\w])|" if k not in ("kotlin", "rust") else r"\.(?![.\w])|" if k == "rust" else "") + r"\.\d[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?[\d_]+)?[A-Za-z_]*\d*")
    for k in EXTENSIONS.values()
}
_SPACE = re.compile(r"[ \t\f\v ﻿  \r\n]+")
#: Most tokens in one match: line ends, line comments, words that begin no literal, brackets and marks that are no part of a longer operator, each with the blanks before it.
_FAST = {k: re.compile(r"[ \t\f]*+(?:([\r\n]\s*+)|(//[^\r\n]*+)|(" + w.pattern + r")" + (r"(?![\w\"'#])" if k == "rust" else "") + r"|([(\[{;,])|([)\]]))").match for k, w in _WORD.items()}
_SHORT = r'"(?:[^"\\\r\n]|\\.)*"'
_STRINGS = {
    "java": [(r'"""', r'"""[ \t\f]*[\r\n](?:[^\\"]|\\[\s\S]|"(?!""))*"""'), (r'"', r'"(?:[^"\\\r\n]|\\(?:[btnfrs"\'\\0-7]|u+[0-9a-fA-F]{4}))*"'), (r"'", r"'(?:[^'\\\r\n]|\\(?:[btnfrs\"'\\]|[0-7]{1,3}|u+[0-9a-fA-F]{4}))'")],
    "go": [(r"`", r"`[^`]*`"), (r'"', r'"(?:[^"\\\n]|\\(?:[abfnrtv\\"]|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))*"'), (r"'", r"'(?:[^'\\\n]|\\(?:[abfnrtv\\']|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))'")],
    "rust": [(r'[bc]?r#*"', None), (r'[bc]?"', r'[bc]?"(?:[^"\\]|\\(?:[nrt\\0\'"\r\n]|x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]+\}))*"'), (r"b?'(?:[^'\\\r\n]|\\[^\r\n]{1,10}?)'", r"b?'(?:[^'\\\r\n]|\\(?:[nrt\\0'\"]|x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]+\}))'"), (r"'(?=[^\W\d])", r"'[^\W\d]\w*"), (r"'", r"'(?!)")],
    "javascript": [(r'"', r'"(?:[^"\\\r\n]|\\(?:\r\n|[\s\S]))*"'), (r"'", r"'(?:[^'\\\r\n]|\\(?:\r\n|[\s\S]))*'")],
    "kotlin": [(r"'", r"'(?:[^'\\\r\n]|\\(?:[tbnr'\"\\$]|u[0-9a-fA-F]{4}))'"), (r"`", r"`[^`\r\n]+`")],
}
_STRINGS["typescript"] = _STRINGS["javascript"]
_STRINGS = {k: [(re.compile(a), b and re.compile(b)) for a, b in v] for k, v in _STRINGS.items()}
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\r\n]|\\[^\r\n]|\[(?:[^\]\\\r\n]|\\[^\r\n])*\])+/[A-Za-z]*")
_FOREIGN_CHARS = {"java": "#\\`$", "kotlin": "#$\\~", "go": "#$\\?@", "rust": "\\~", "javascript": "\\@#", "typescript": "\\#"}
CLOSES = {")": "(", "]": "[", "}": "{"}
_VALUE_ENDS = {")", "]", "}"}
_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "instanceof", "yield", "await"}


def _template_end(text: str, i: int, quote: str, simple: bool) -> tuple[int, bool]:
    """From inside a template: where its text stops, and whether code begins there."""
    n = len(text)
    while i < n:
        c = text[i]
        if c == "\\" and quote != '"""':
            i += 2
        elif text.startswith(quote, i):
            i += len(quote)
            if quote == '"""':
                while i < n and text[i] == '"':
                    i += 1
            return i, False
        elif c == "$" and text.startswith("${", i):
            return i + 2, True
        elif c in "\r\n" and quote == '"':
            break
        else:
            i += 1
    raise Bad("unterminated_literal")


def lex(text: str, language: str, at: list[int] | None = None) -> list[tuple[str, str, bool]]:
    """(kind, text, first on its line) of each token; kinds: w word, n number, s literal, o operator or bracket, l lifetime.

    at: an empty list that gets each token's place in the text.
    """
    out: list[tuple[str, str, bool]] = []
    stack: list[str] = []
    i, n, fresh = 0, len(text), True
    nested = language in ("kotlin", "rust")
    word, num, strings, strange = _WORD[language], _NUM[language], _STRINGS[language], _FOREIGN_CHARS[language]
    ecma = language in ("javascript", "typescript")
    if text.startswith("#!") and language in ("kotlin", "javascript", "typescript", "rust") and not text.startswith("#!["):
        i = len(re.match(r"[^\r\n]*", text)[0])
    begin, fast = 0, _FAST[language]
    while i < n:
        if at is not None:
            at.extend([begin] * (len(out) - len(at)))
            begin = i
        if m := fast(text, i):
            i, k = m.end(), m.lastindex
            if k == 3:
                out.append(("w", m[3], fresh))
            elif k == 1:
                fresh = True
                continue
            elif k == 2:
                continue
            else:
                t = m[k]
                if k == 5:
                    if not stack or stack.pop() != CLOSES[t]:
                        raise Bad("unbalanced")
                elif t in "([{":
                    stack.append(t)
                out.append(("o", t, fresh))
            fresh = False
            if at is not None:
                begin = m.start(k)
            continue
        if m := _SPACE.match(text, i):
            fresh = fresh or "\n" in m[0] or "\r" in m[0]
            i = m.end()
            continue
        c = text[i]
        if (i == 0 or text[i - 1] in "\r\n") and MARK.match(text, i):
            raise Bad("conflict_marker")
        if c == "/" and text.startswith("//", i):
            m = re.compile(r"[^\r\n]*").match(text, i)
            i = m.end()
            continue
        if c == "/" and text.startswith("/*", i):
            depth, j = 1, i + 2
            while depth:
                a, b = text.find("*/", j), text.find("/*", j) if nested else -1
                if a < 0:
                    raise Bad("unterminated_comment")
                if 0 <= b < a:
                    depth, j = depth + 1, b + 2
                else:
                    depth, j = depth - 1, a + 2
            fresh = fresh or "\n" in text[i:j]
            i = j
            continue
        if stack and c == "}" and stack[-1] in ('"', '"""', "`"):
            quote = stack.pop()
            out.append(("o", ")", fresh))
            i, code = _template_end(text, i + 1, quote, False)
            if code:
                stack.append(quote)
                out.append(("o", ",", False))
                out.append(("o", "(", False))
            else:
                out.append(("o", ")", False))
            fresh = False
            continue
        if (ecma and c == "`") or (language == "kotlin" and c == '"'):
            quote = "`" if c == "`" else '"""' if text.startswith('"""', i) else '"'
            i, code = _template_end(text, i + len(quote), quote, language == "kotlin")
            out.append(("s", "``", fresh))
            if code:
                stack.append(quote)
                out += [("o", "(", False), ("o", "(", False)]
            fresh = False
            continue
        hit = None
        for start, whole in strings:
            if m := start.match(text, i):
                if whole is None:
                    hashes = m[0].count("#")
                    j = text.find('"' + "#" * hashes, m.end())
                    if j < 0:
                        raise Bad("unterminated_literal")
                    hit = j + 1 + hashes
                elif w := whole.match(text, i):
                    hit = w.end()
                else:
                    raise Bad("unterminated_literal")
                break
        if hit is not None:
            t = text[i:hit]
            kind = "l" if language == "rust" and t[0] == "'" and (len(t) < 2 or t[-1] != "'") else "w" if language == "kotlin" and t[0] == "`" else "s"
            out.append((kind, t, fresh))
            i, fresh = hit, False
            continue
        if ecma and c == "/" and (not out or (out[-1][0] == "o" and out[-1][1] not in _VALUE_ENDS) or (out[-1][0] == "w" and out[-1][1] in _BEFORE_REGEX)):
            m = _REGEX.match(text, i)
            if not m:
                raise Bad("unterminated_literal")
            out.append(("s", m[0], fresh))
            i, fresh = m.end(), False
            continue
        if m := word.match(text, i):
            if language == "rust" and m[0] == "r" and text.startswith("r#", i) and (q := word.match(text, i + 2)):
                m = q
            out.append(("w", m[0], fresh))
            i, fresh = m.end(), False
            continue
        if c.isdigit() or (c == "." and i + 1 < n and text[i + 1].isdigit() and language != "rust"):
            m = num.match(text, i)
            out.append(("n", m[0], fresh))
            i, fresh = m.end(), False
            continue
        if ecma and c == "#" and (m := word.match(text, i + 1)):
            out.append(("w", "#" + m[0], fresh))
            i, fresh = m.end(), False
            continue
        m = _OP.match(text, i)
        if not m or c in strange or text.startswith("....", i):
            raise Bad("bad_character" if not m or c in strange else "unexpected_token")
        t = m[0]
        if t in ("?:", "..<", ":=", "<-", "&^", "&^=", "..=", "!!") and ((ecma and t != "!!") or (language == "java" and t != "!!") or (t == "!!" and language != "kotlin") or (t == "?:" and language != "kotlin") or (t == "<-" and language != "go")):
            t = t[0]
        if t in "([{":
            stack.append(t)
        elif t in CLOSES:
            if not stack or stack.pop() != CLOSES[t]:
                raise Bad("unbalanced")
        out.append(("o", t, fresh))
        i, fresh = i + len(t), False
    if stack:
        raise Bad("premature_end")
    if at is not None:
        at.extend([begin] * (len(out) - len(at)))
    return out


def tree(tokens: list[tuple[str, str, bool]]) -> list[tuple]:
    """Tokens with each bracket pair as one item: (kind, children, first on its line), kind one of ( [ {."""
    levels: list[list] = [[]]
    opened: list[tuple[str, bool]] = []
    for k, t, f in tokens:
        if k == "o" and t in "([{":
            levels.append([])
            opened.append((t, f))
        elif k == "o" and t in CLOSES:
            inner = levels.pop()
            b, f = opened.pop()
            levels[-1].append((b, inner, f))
        else:
            levels[-1].append((k, t, f))
    return levels[0]
