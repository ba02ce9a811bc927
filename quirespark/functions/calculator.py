"""PostScript calculator functions: a program of numbers, operators and braced procedures over a stack."""

from __future__ import annotations

import math
import operator
import re

_TOKEN = re.compile(rb"[{}]|[^\s{}]+")
#: Longest program that is run, in steps: damaged ones end.
STEPS = 100_000


def parse(program: bytes) -> list:
    """Tokens of a program, procedures as nested lists."""
    stack: list[list] = [[]]
    for token in _TOKEN.findall(re.sub(rb"%[^\r\n]*", b"", program)):
        if token == b"{":
            stack.append([])
        elif token == b"}":
            if len(stack) > 1:
                done = stack.pop()
                stack[-1].append(done)
        else:
            word = token.decode("latin-1")
            try:
                stack[-1].append(int(word))
            except ValueError:
                try:
                    stack[-1].append(float(word))
                except ValueError:
                    stack[-1].append(word)
    return stack[0][0] if stack[0] and isinstance(stack[0][0], list) else []


def _divided(a: float, b: float) -> float:
    return a / b if b else 0.0


def _whole(a: float, b: float) -> int:
    return int(a / b) if b else 0


def _shifted(a: float, n: float) -> int:
    return int(a) << int(n) if n >= 0 else int(a) >> -int(n)


_ONE = {
    "abs": abs, "neg": operator.neg, "ceiling": math.ceil, "floor": math.floor, "truncate": math.trunc, "round": lambda a: math.floor(a + 0.5), "cvi": int, "cvr": float,
    "sqrt": lambda a: math.sqrt(max(0.0, a)), "sin": lambda a: math.sin(math.radians(a)), "cos": lambda a: math.cos(math.radians(a)),
    "ln": lambda a: math.log(a) if a > 0 else 0.0, "log": lambda a: math.log10(a) if a > 0 else 0.0, "not": lambda a: not a if isinstance(a, bool) else ~int(a),
}
_TWO = {
    "add": operator.add, "sub": operator.sub, "mul": operator.mul, "div": _divided, "idiv": _whole, "mod": lambda a, b: math.fmod(a, b) if b else 0, "exp": operator.pow,
    "atan": lambda a, b: math.degrees(math.atan2(a, b)) % 360, "eq": operator.eq, "ne": operator.ne, "gt": operator.gt, "ge": operator.ge, "lt": operator.lt, "le": operator.le,
    "and": operator.and_, "or": operator.or_, "xor": operator.xor, "bitshift": _shifted,
}


def run(program: list, inputs: list[float]) -> list[float]:
    """What a parsed program leaves on the stack."""
    stack: list = list(inputs)
    todo = list(reversed(program))
    for _ in range(STEPS):
        if not todo:
            return [float(x) for x in stack if isinstance(x, (int, float))]
        word = todo.pop()
        if not isinstance(word, str):
            stack.append(word)
        elif word in _TWO:
            b, a = stack.pop(), stack.pop()
            stack.append(_TWO[word](a, b))
        elif word in _ONE:
            stack.append(_ONE[word](stack.pop()))
        elif word in ("true", "false"):
            stack.append(word == "true")
        elif word in ("if", "ifelse"):
            otherwise = stack.pop() if word == "ifelse" else []
            then = stack.pop()
            todo += reversed(then if stack.pop() else otherwise)
        elif word == "pop":
            stack.pop()
        elif word == "dup":
            stack.append(stack[-1])
        elif word == "exch":
            stack[-2:] = stack[:-3:-1]
        elif word == "copy":
            n = int(stack.pop())
            stack += stack[len(stack) - n :] if n > 0 else []
        elif word == "index":
            stack.append(stack[-1 - int(stack.pop())])
        elif word == "roll":
            by, n = int(stack.pop()), int(stack.pop())
            if n > 0:
                by %= n
                held = stack[-n:]
                stack[-n:] = held[n - by :] + held[: n - by]
        else:
            raise ValueError(f"calculator: {word}")
    raise ValueError("calculator: too long")
