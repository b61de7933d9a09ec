"""The query surface's spellings, rewritten token by token into Spark's.

A statement or condition is cut into tokens, some of them are replaced, and Spark parses the rest.
Comparisons keep two-valued logic: ``!=`` is true beside a null, and so is a NOT over a test that
null makes undecided; the test under a NOT is found by precedence.  In ON, where tests
pair rows, they stay Spark's, so that nulls meet nothing.
"""

from __future__ import annotations

import re

from ..functions import SQL_NAMES

_TOKEN = re.compile(r"""/\*.*?\*/|--[^\n]*|'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*"|`(?:[^`]|``)*`|[A-Za-z_][\w.]*(?:[/-][\w.]+)*(?=\s|\)|;|$)|[A-Za-z_][\w.]*|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|<=>|<>|!=|==|<=|>=|\s+|.""", re.S)
_COMPARE = {"==": "<=>", "=": "<=>", "!=": "IS DISTINCT FROM", "<>": "IS DISTINCT FROM"}
_AGGREGATES = frozenset("SUM MAX MIN AVG COUNT".split())
_TESTS = frozenset("IN LIKE MATCHES CONTAINS ILIKE RLIKE REGEXP BETWEEN".split())  # a NOT may stand before these
_NOT_NAMES = _TESTS | frozenset("AND OR NOT IS SELECT DISTINCT FROM WHERE GROUP BY HAVING ORDER LIMIT AS ASC DESC ON WHEN THEN ELSE CASE QUALIFY ESCAPE DIV ALL".split())
_SIGNS = frozenset("+ - * / % || & | ^ DIV".split())


def tokens(text: str) -> list[str]:
    """Comments become a blank, and white space outside quotes a single one."""
    found = _TOKEN.findall(text.strip().rstrip(";"))
    return [" " if t.isspace() or t.startswith(("--", "/*")) else t for t in found]


def _next(found: list[str], i: int, step: int = 1) -> int:
    i += step
    while 0 <= i < len(found) and found[i] == " ":
        i += step
    return i


def _at(found: list[str], i: int) -> str:
    return found[i] if 0 <= i < len(found) else ""


def _given_names(found: list[str]) -> set[str]:
    """Names that WITH gives to subqueries, in lower case."""
    out: set[str] = set()
    for i, t in enumerate(found):
        if t.upper() != "WITH":
            continue
        j = _next(found, i)
        if _at(found, j).upper() == "RECURSIVE":
            j = _next(found, j)
        while re.match(r"[A-Za-z_`]", _at(found, j)):
            name, j = found[j], _next(found, j)
            if _at(found, j) == "(":
                j = _next(found, _closing(found, j) - 1)
            if _at(found, j).upper() != "AS" or _at(found, _next(found, j)) != "(":
                break
            out.add(name.strip("`").lower())
            j = _next(found, _closing(found, _next(found, j)) - 1)
            if _at(found, j) != ",":
                break
            j = _next(found, j)
    return out


def dataset_places(found: list[str]) -> list[int]:
    """Places of the names after FROM and JOIN; subqueries and their names are passed over, and so
    are the FROM of IS DISTINCT FROM and of functions such as EXTRACT."""
    out, inside, given = [], [], _given_names(found)
    for i, t in enumerate(found):
        if t == "(":
            inside.append(_at(found, _next(found, i, -1)).upper())
        elif t == ")" and inside:
            inside.pop()
        before = _next(found, i, -1)
        compared = _at(found, before).upper() == "DISTINCT" and _at(found, _next(found, before, -1)).upper() in ("IS", "NOT")
        j = _next(found, i)
        if t.upper() not in ("FROM", "JOIN") or compared or (inside and inside[-1] in _WITH_FROM) or not re.match(r"[A-Za-z_]", _at(found, j)):
            continue
        k = j + 1
        while k < len(found) and found[k] != " " and (found[k] in "/-." or re.fullmatch(r"[\w.]+", found[k])):
            k += 1
        found[j:k] = ["".join(found[j:k]), *[""] * (k - j - 1)]
        if found[j].lower() not in given:
            out.append(j)
    return out


def has_alias(found: list[str], i: int) -> bool:
    """Whether a name follows the one at i."""
    after = next((t for t in found[i + 1 :] if t.strip()), "")
    return bool(re.match(r"[A-Za-z_`]", after)) and after.upper() not in _CLAUSES


_CLAUSES = frozenset("WHERE GROUP HAVING ORDER LIMIT ON USING JOIN INNER LEFT RIGHT FULL CROSS OUTER SEMI ANTI NATURAL LATERAL UNION INTERSECT EXCEPT MINUS QUALIFY WINDOW CLUSTER DISTRIBUTE SORT OFFSET TABLESAMPLE PIVOT".split())
_WITH_FROM = frozenset("EXTRACT TRIM SUBSTRING OVERLAY".split())


def check_dataset(name: str) -> None:
    """A name starts with a letter and holds letters, digits and . / - _, none of the marks
    twice in a row."""
    if not re.fullmatch(r"[A-Za-z][\w./-]*", name) or re.search(r"\.\.|//|--", name):
        raise ValueError(f"not a dataset name: {name!r}")


def _closing(found: list[str], i: int) -> int:
    """The place behind the parenthesis that closes the one at i."""
    depth = 0
    for j in range(i, len(found)):
        depth += (found[j] == "(") - (found[j] == ")")
        if not depth:
            return j + 1
    return len(found)


def labelled(found: list[str]) -> list[str]:
    """Functions of the select list without a name get one: FUNCTION(a,b)."""
    out, i = [], 0
    while i < len(found):
        out.append(found[i])
        if found[i].upper() == "SELECT":
            i = _next(found, i)
            out.append(" ")
            if _at(found, i).upper() == "DISTINCT":
                out += [found[i], " "]
                i = _next(found, i)
            start, depth = i, 0
            while i <= len(found):
                t = _at(found, i).upper()
                depth += (t == "(") - (t == ")")
                ends = i == len(found) or (depth < 0) or (depth == 0 and t == "FROM")
                if ends or (depth == 0 and t == ","):
                    item = found[start:i]
                    out += [*item, *_label(item)]
                    if ends:
                        break
                    out.append(",")
                    start = i + 1
                i += 1
            continue
        i += 1
    return out


def aliased(found: list[str]) -> list[str]:
    """Names that the select list gives to functions stand for them in WHERE."""
    out, named, where, depth = [], {}, None, 0
    for i, t in enumerate(found):
        depth += (t == "(") - (t == ")")
        word = t.upper()
        if word == "AS" and out:
            end = _next(found, i)
            start = _operand(out)
            if len(out) - start > 1 and out[start].upper() not in _AGGREGATES and re.fullmatch(r"[A-Za-z_]\w*", _at(found, end)) and "(" in out[start:]:
                named[found[end], depth] = "".join(out[start:]).strip()
        elif word == "WHERE":
            where = depth
        elif word in ("GROUP", "HAVING", "ORDER", "LIMIT", "SELECT") or (where is not None and depth < where):
            where = None
        if where is not None and (t, where) in named:
            out.append(f"({named[t, where]})")
        else:
            out.append(t)
    return tokens("".join(out))


def _label(item: list[str]) -> list[str]:
    parts = [t for t in item if t not in (" ", "")]
    if len(parts) < 3 or parts[1] != "(" or not re.fullmatch(r"[A-Za-z_]\w*", parts[0]) or _closing(parts, 1) != len(parts):
        return []
    return [f" AS `{label(parts)}` "]


def label(parts: list[str]) -> str:
    named = [t.upper() if re.fullmatch(r"[A-Za-z_]\w*", t) and _at(parts, i + 1) == "(" else t.strip("`") for i, t in enumerate(parts)]
    return "".join(named).replace("`", "``")


def _ends_operand(found: list[str], i: int) -> bool:
    """Whether the last token before place i ends a value: a name, a literal or a call."""
    t = _at(found, _next(found, i, -1))
    return bool(t) and t not in _SIGNS and t not in "(,=<>" and t not in _COMPARE and t not in ("<=", ">=", "<=>", " ") and t.upper() not in _NOT_NAMES


def lowered(found: list[str] | str, lists: frozenset[str] | set[str] = frozenset(), pairing: bool = False) -> str:
    """The text for Spark.  ``lists``: lower-case names of columns that are arrays; ``pairing``:
    the text is within ON."""
    found = tokens(found) if isinstance(found, str) else [t for t in found if t != ""]
    out: list[str] = []
    outer: list[bool] = []
    i = 0
    while i < len(found):
        t, word, after = found[i], found[i].upper(), _next(found, i)
        if t == "(":
            outer.append(pairing)
        elif t == ")" and outer:
            pairing = outer.pop()
        elif word == "ON":
            pairing = True
        elif word in _ENDS_ON:
            pairing = False
        if word == "NOT" and _at(found, after).upper() in _TESTS and _ends_operand(found, i):
            start, end = _left(out), _condition(found, after, True)
            test = lowered([*out[start:], " ", *found[after:end]], lists, pairing)
            out[start:] = [f"NOT coalesce({test.strip()}, false)"]
            i = end
            continue
        if word == "NOT" and _at(found, _next(found, i, -1)).upper() != "IS" and _at(found, after).upper() not in ("NULL", "NONE", "EXISTS", "DETERMINISTIC", ""):
            end = _condition(found, after)
            out.append(f"NOT coalesce({lowered(found[i + 1 : end], lists, pairing).strip()}, false)")
            i = end
            continue
        if t in _COMPARE:
            out.append({"==": " = "}.get(t, f" {t} ") if pairing else f" {_COMPARE[t]} ")
        elif word == "LIKE":
            out.append("ILIKE")
        elif word == "MATCHES":
            out.append("RLIKE")
        elif word == "NONE" and _at(found, _next(found, i, -1)).upper() in ("IS", "NOT"):
            out.append("NULL")
        elif word == "CONTAINS" and _at(found, after) != "(":
            start, value = _operand(out), after
            name = "".join(out[start:]).strip()
            test = "array_contains" if name.strip("`").lower() in lists else "contains"
            out[start:] = [f"{test}({name}, {_at(found, value)})"]
            i = value
        elif word in SQL_NAMES and _at(found, after) == "(" and not (word in _TESTS and _ends_operand(found, i)):
            end = _closing(found, after)
            inside = found[after + 1 : end - 1]
            args = _arguments(inside)
            if word in _WITH_FROM and _own(inside, "FROM"):
                out.append(f"{t}({lowered(inside, lists, pairing)})")
            else:
                out.append(SQL_NAMES[word]([lowered(a, lists, pairing).strip() for a in args], args, lists))
            i = end - 1
        elif word in _AGGREGATES and _at(found, after) == "(":
            out.append(t)
            i = after - 1  # no blank before the parenthesis
        else:
            out.append(t)
        i += 1
    return "".join(out)


_ENDS_ON = frozenset("SELECT WHERE GROUP HAVING ORDER LIMIT QUALIFY UNION INTERSECT EXCEPT MINUS WINDOW".split())


def _own(found: list[str], word: str) -> bool:
    """Whether a word stands outside parentheses."""
    depth = 0
    for t in found:
        depth += (t == "(") - (t == ")")
        if not depth and t.upper() == word:
            return True
    return False


def _arguments(found: list[str]) -> list[list[str]]:
    out, depth = [[]], 0
    for t in found:
        depth += (t == "(") - (t == ")")
        if t == "," and not depth:
            out.append([])
        else:
            out[-1].append(t)
    return [a for a in out if "".join(a).strip()]


_ENDS_TEST = _ENDS_ON | frozenset("OR THEN WHEN ELSE AS ASC DESC NULLS FROM ON JOIN , )".split())
_JOINS = frozenset("LEFT RIGHT INNER FULL CROSS NATURAL SEMI ANTI".split())


def _condition(found: list[str], i: int, test: bool = False) -> int:
    """The place behind the condition that starts at i: what binds closer than AND and OR, with the
    AND of each BETWEEN and all within parentheses and CASE.  ``test``: i is at a test's word, whose
    left side stands before."""
    depth = between = 0
    first = i
    while i < len(found):
        t = found[i].upper()
        if t in ("(", "CASE"):
            depth += 1
        elif t in (")", "END"):
            depth -= 1
        if depth < 0:
            break
        if not depth:
            if t == "BETWEEN" and ((test and i == first) or _ends_operand(found[first:i], i - first)):
                between += 1
            elif t == "AND" and between:
                between -= 1
            elif t == "AND" or (t in _ENDS_TEST and found[i] not in "()") or (t in _JOINS and _at(found, _next(found, i)) != "("):
                if not (t == "FROM" and _at(found, _next(found, i, -1)).upper() == "DISTINCT"):
                    break
        i += 1
    while i > first and found[i - 1] == " ":
        i -= 1
    return i


def _left(out: list[str]) -> int:
    """Where the left side of a test at the end of ``out`` starts: operands joined by signs."""
    start = _operand(out)
    while (sign := _next(out, start, -1)) >= 0 and _at(out, sign).strip().upper() in _SIGNS:
        if not _ends_operand(out, sign):  # a sign of its own
            return sign
        start = _operand(out[:sign])
    return start


def _operand(out: list[str]) -> int:
    """Where the operand at the end of ``out`` starts: a name, a value or a call."""
    i = len(out) - 1
    while i > 0 and out[i] == " ":
        i -= 1
    if out and out[i] == ")":
        depth = 0
        while i >= 0:
            depth += (out[i] == ")") - (out[i] == "(")
            if not depth:
                break
            i -= 1
        if i > 0 and re.fullmatch(r"[A-Za-z_]\w*", out[i - 1]) and out[i - 1].upper() not in _NOT_NAMES:
            i -= 1
    return max(i, 0)
