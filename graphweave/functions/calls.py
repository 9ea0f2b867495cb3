"""Facts of single calls, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphweave.functions.masks import cleared, mask

# Calls and casts, and the kinds of taint that each clears whatever its arguments are.
CLEARS = {
    "e": ["html"], "htmlspecialchars": ["html"], "htmlentities": ["html"],
    "intval": ["sql", "html", "path"], "floatval": ["sql", "html", "path"], "(int)": ["sql", "html"], "(float)": ["sql", "html"],
    "escapeshellarg": ["shell"], "escapeshellcmd": ["shell"], "basename": ["path"], "urlencode": ["url"], "rawurlencode": ["url"],
    "Js::from": ["js", "html"],
}
# Calls that clear these kinds only where an argument names the flag.
CLEARS_WITH_FLAG = {"json_encode": ("JSON_HEX_TAG", ["js", "html"])}


def argument(args: Column, name: str, place: int) -> Column:
    """The argument that reaches a parameter: the first named like it, else the one at its place (from 0) among those without a name; null where there is none. ``args`` is an array of structs with ``name``."""
    named = F.get(F.filter(args, lambda a: a["name"] == name), F.lit(0))
    return F.coalesce(named, F.get(F.filter(args, lambda a: a["name"].isNull()), F.lit(place)))


def answers_html(chain: Column) -> Column:
    """Whether a chain of calls, the receiver first, answers with HTML: it makes a response or a view and no call of it makes that JSON."""
    has = lambda *names: F.exists(chain, lambda x: F.coalesce(x.isin(*names), F.lit(False)))
    return F.coalesce(has("response", "view", "make") & ~has("json", "jsonp"), F.lit(False))


def bound_class(scope: Column, lexical: Column, runtime: Column, parent: Column, in_trait: Column) -> Column:
    """The class that a static scope means: ``self`` the one it stands in (in a trait the one that composes it), ``static`` the one at run time, ``parent`` its parent (null: none), else the name itself."""
    own = F.when(in_trait, runtime).otherwise(lexical)
    return F.when(scope == "self", own).when(scope == "static", runtime).when(scope == "parent", parent).otherwise(scope)


def unsafe_write(index: Column, arguments: Column, tainted: Column, protection: Column, bypass: Column) -> Column:
    """Whether an array write can set what it should not, in three values: null where it is no write (no ``index``) of a known model (no ``protection``), false where it has no such argument, one without taint, or a guarded model that it does not pass by, else true."""
    safe = (index >= arguments) | ~tainted | ((protection == "guarded") & ~bypass)
    return F.when(index.isNotNull() & protection.isNotNull(), ~F.coalesce(safe, F.lit(False)))


def with_markers(steps: Column, weak: str = "weak") -> Column:
    """Steps in order, each with role ``call``, and after each that is ``weak`` a step of role ``weak-control``: an array of structs of ``step`` and ``role``."""
    one = lambda x, role: F.struct(x["step"].alias("step"), F.lit(role).alias("role"))
    return F.flatten(F.transform(F.array_sort(steps), lambda x: F.when(x[weak], F.array(one(x, "call"), one(x, "weak-control"))).otherwise(F.array(one(x, "call")))))


def clears(call: Column, args: Column, always: dict[str, list[str]] = CLEARS, with_flag: dict[str, tuple[str, list[str]]] = CLEARS_WITH_FLAG) -> Column:
    """The kinds (bits) that a call clears: what it always clears and, where the text of an argument names its flag as a whole word, what that adds. ``args`` is an array of structs with ``value``. Other calls, and null, clear none."""
    names = F.create_map(*[F.lit(x) for name, kinds in always.items() for x in (name, mask(*kinds))])
    out = F.coalesce(F.try_element_at(names, call), F.lit(0))
    for name, (flag, kinds) in with_flag.items():
        flagged = F.exists(args, lambda a: F.coalesce(a["value"].rlike(rf"(?<![A-Za-z0-9_]){flag}(?![A-Za-z0-9_])"), F.lit(False)))
        out = out.bitwiseOR(F.when((call == name) & flagged, mask(*kinds)).otherwise(0))
    return out


def returned_taint(call: Column, args: Column, **tables) -> Column:
    """The taint (bits) of what a call returns: that of all its arguments (``taint`` in ``args``, null: none) without what it clears; an unknown call passes all of it on."""
    every = F.aggregate(F.transform(args, lambda a: a["taint"].cast("int")), F.lit(0), lambda acc, t: acc.bitwiseOR(F.coalesce(t, F.lit(0))))
    return cleared(F.coalesce(every, F.lit(0)), clears(call, args, **tables))
