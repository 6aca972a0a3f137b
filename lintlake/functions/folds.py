"""Folds over an array inside a row, as SQL text.

A fold whose state holds the rows found so far copies them at every step, which is quadratic in the
array. Here an inner fold runs over PART elements with its own list of findings, and an outer one
adds whole lists; they are put together once at the end.
"""

from __future__ import annotations

PART = 48


def parts(array: str, part: int = PART) -> str:
    """The array in pieces of `part` elements. `slice` would walk the whole array for each of them."""
    last = f"size({array}) - 1"
    piece = f"transform(sequence(c * {part}, least(c * {part} + {part - 1}, {last})), k -> get({array}, k))"
    return (
        f"transform(if(size({array}) > 0, sequence(0, cast(({last}) div {part} as int)), "
        f"cast(array() as array<int>)), c -> {piece})"
    )


def fold(
    array: str, state: dict[str, str], step: dict[str, str], out_type: str, out: str, rest: str = "",
    when: str | None = None,
) -> str:
    """All findings of a fold over `array`, in order.

    `state` gives the first value of every state column and `step` its next one, an expression over
    `a.<column>` and the element `x`; columns without a step stay as they are. `out` is an array of
    `out_type` that a step finds, or NULL; with `when`, one value wherever that holds. `rest` is what the last state adds, over `b.<column>`.
    """
    names = list(state)
    of = lambda row, more: "struct(" + ", ".join([*(f"{row}.{n} as {n}" for n in names), more]) + ")"
    none = f"cast(array() as array<{out_type}>)"
    nones = f"cast(array() as array<array<{out_type}>>)"
    first = "struct(" + ", ".join([*(f"{v} as {n}" for n, v in state.items()), f"{nones} as found"]) + ")"
    onward = ", ".join(f"{step.get(n, f'a.{n}')} as {n}" for n in names)
    grown = (
        f"if({when}, array_append(a.found, {out}), a.found)" if when
        else f"coalesce(concat(a.found, {out}), a.found)"
    )
    inner = (
        f"aggregate(p, {of('b', f'{none} as found')}, "
        f"(a, x) -> struct({onward}, {grown} as found), "
        f"a -> {of('a', 'array_append(b.found, a.found) as found')})"
    )
    whole = "flatten(b.found)" if not rest else f"concat(flatten(b.found), {rest})"
    return f"aggregate({parts(array)}, {first}, (b, p) -> {inner}, b -> {whole})"
