"""Array helpers on score arrays.

All of them are higher-order Column expressions evaluated inside whole-stage
code generation; none needs a Python worker."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def let(fn, **exprs) -> Column:
    """Evaluate each expression once and hand it to ``fn`` as a lambda variable.

    Higher-order functions inline their argument expressions into the lambda
    body; an array built by sorting (e.g. ``top_ids``) that is read inside a
    nested lambda would be rebuilt on every iteration.  Binding it through a
    one-element ``transform`` computes it once per row."""
    names = list(exprs)
    st = F.struct(*[exprs[k].alias(k) for k in names])
    return F.element_at(F.transform(F.array(st), lambda s: fn(*[s[k] for k in names])), 1)


def top_ids(scores, n: int | None, ties: str = "asc", id_field: str = "category_id",
            score_field: str = "probability") -> Column:
    """Category ids of a score array ordered by score descending, first ``n``
    (all when ``n`` is None; shorter arrays give shorter lists).

    ties: ``asc``    equal scores by id ascending
          ``desc``   equal scores by id descending (``sort_array(..., False)``)
          ``stable`` equal scores keep their input order"""
    s = _c(scores)
    if ties == "asc":
        keyed = F.transform(s, lambda x: F.struct((-x[score_field]).alias("k"), x[id_field].alias("id")))
        ordered = F.transform(F.array_sort(keyed), lambda x: x["id"])
    elif ties == "desc":
        keyed = F.transform(s, lambda x: F.struct(x[score_field].alias("k"), x[id_field].alias("id")))
        ordered = F.transform(F.sort_array(keyed, asc=False), lambda x: x["id"])
    elif ties == "stable":
        keyed = F.transform(s, lambda x, i: F.struct((-x[score_field]).alias("k"), i.alias("i"),
                                                      x[id_field].alias("id")))
        ordered = F.transform(F.array_sort(keyed), lambda x: x["id"])
    else:
        raise ValueError(f"unknown tie rule {ties!r}")
    if n is None:
        return ordered
    return F.slice(ordered, 1, n)


def rank_of(item, arr) -> Column:
    """1-based position of ``item`` in ``arr``; ``size(arr) + 1`` when absent."""
    pos = F.array_position(_c(arr), _c(item))
    return F.when(pos > 0, pos).otherwise(F.size(_c(arr)) + 1).cast("int")
