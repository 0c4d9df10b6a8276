"""Small text and timing helpers."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands before a node's number in the value of a node without attributes.
TOKEN = "*???*_"


def token(node: Column) -> Column:
    """The stand-in value of a node that has no value of a type."""
    return F.concat(F.lit(TOKEN), node.cast("string"))


def time_format(seconds: float) -> str:
    hours, rest = divmod(seconds, 3600)
    minutes, rest = divmod(rest, 60)
    return f"{hours:.0f}h,{minutes:.0f}m,{rest:.3f}s"


def timed(function: Callable, say: Callable[[str], None] = print) -> Callable:
    """The function, with the time that each call took said."""

    @wraps(function)
    def run(*args, **kwargs):
        began = time.time()
        out = function(*args, **kwargs)
        say(f"{function.__name__}: {time_format(time.time() - began)}")
        return out

    return run


def underscored(text: Column) -> Column:
    """White-space runs as single underscores, none at the ends."""
    return F.regexp_replace(F.trim(text), r"\s+", "_")


def legend(name: str, value: object, suppress: bool = False) -> str:
    return str(value) if suppress else f"{name} = {value}"
