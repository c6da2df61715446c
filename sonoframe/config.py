"""Values that are fixed while a plan is built: devices, version ranges, preconditions of operators."""

from __future__ import annotations

import operator
import re
import sys
from collections.abc import Callable
from dataclasses import dataclass, field
from enum import Enum
from functools import wraps
from importlib import metadata


class Device(Enum):
    CPU = "cpu"
    CUDA = "cuda"
    MPS = "mps"


#: Number type of a device (fixed values).
NUMBER_TYPES = {Device.CPU: "float32", Device.CUDA: "float16", Device.MPS: "float32"}


def select_device(usable: set[Device], wanted: Device | None = None, compatible: tuple[Device, ...] = tuple(Device)) -> tuple[Device, str]:
    """The wanted device, which must be usable and compatible, else the first usable of CUDA, MPS and CPU; and its
    number type."""
    fine = [d for d in (Device.CUDA, Device.MPS, Device.CPU) if d in usable | {Device.CPU} and d in compatible]
    if wanted is not None and wanted not in fine:
        raise ValueError(f"{wanted.value} can't be used here")
    if not fine:
        raise ValueError("no compatible device")
    device = wanted or fine[0]
    return device, NUMBER_TYPES[device]


_OPERATORS = {">=": operator.ge, "<=": operator.le, ">": operator.gt, "<": operator.lt, "==": operator.eq, "!=": operator.ne}


def _numbers(version: str) -> tuple[int, ...]:
    parts = [int(x) for x in re.findall(r"\d+", version.split("+")[0])[:4]]
    return tuple(parts + [0] * (4 - len(parts)))


@dataclass(frozen=True)
class VersionRange:
    """Comparisons such as ``>=3.12,<4`` that a version has to fulfil."""

    text: str = ""

    def __contains__(self, version: str) -> bool:
        for part in filter(None, (p.strip() for p in self.text.split(","))):
            sign, bound = re.fullmatch(r"(>=|<=|==|!=|>|<)\s*(\S+)", part).groups()
            if not _OPERATORS[sign](_numbers(version), _numbers(bound)):
                return False
        return True


@dataclass(frozen=True)
class Precondition:
    """What an operator needs: a range of Python and of packages; ``isolated`` ones bring their own."""

    python: VersionRange = VersionRange()
    packages: dict[str, VersionRange] = field(default_factory=dict)
    isolated: bool = False


#: Preconditions by operator name.
PRECONDITIONS = {
    "token_count": Precondition(packages={"tiktoken": VersionRange(">=0.5")}),
    "kernels": Precondition(VersionRange(">=3.10"), {"numpy": VersionRange(">=1.24"), "pyarrow": VersionRange(">=11")}),
}


def check_precondition(name: str, table: dict[str, Precondition] | None = None) -> bool:
    """True if ``name`` is unknown, isolated or fulfilled; otherwise raises with what is missing."""
    entry = (PRECONDITIONS if table is None else table).get(name)
    if entry is None or entry.isolated:
        return True
    python = ".".join(map(str, sys.version_info[:3]))
    if python not in entry.python:
        raise RuntimeError(f"{name} needs Python {entry.python.text}, not {python}")
    for package, wanted in entry.packages.items():
        try:
            found = metadata.version(package)
        except metadata.PackageNotFoundError:
            raise RuntimeError(f"{name} needs {package}") from None
        if found not in wanted:
            raise RuntimeError(f"{name} needs {package} {wanted.text}, not {found}")
    return True


def requires(name: str, table: dict[str, Precondition] | None = None) -> Callable:
    """A decorator that checks the precondition before each call."""

    def decorate(f: Callable) -> Callable:
        @wraps(f)
        def call(*args, **kwargs):
            check_precondition(name, table)
            return f(*args, **kwargs)

        return call

    return decorate


def evaluation_name(f: Callable) -> str:
    """A metric's or check's name; another ending raises."""
    if not f.__name__.endswith(("_metric", "_check")):
        raise ValueError(f"{f.__name__} ends in neither _metric nor _check")
    return f.__name__
