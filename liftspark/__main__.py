"""python -m liftspark explain MODULE:FUNCTION [--columns N]: what the engine reads in a function."""

from __future__ import annotations

import argparse
import importlib
import json
import sys

from . import ir
from .capture import Rejected, capture
from .udf import Function


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="liftspark")
    commands = parser.add_subparsers(dest="command", required=True)
    explain = commands.add_parser("explain")
    explain.add_argument("target")
    explain.add_argument("--columns", type=int, default=1)
    args = parser.parse_args(argv)
    module, _, name = args.target.partition(":")
    target = importlib.import_module(module)
    for part in name.split("."):
        target = getattr(target, part)
    fn = target.fn if isinstance(target, Function) else target
    try:
        found = capture(fn, n_columns=args.columns)
    except Rejected as e:
        print(json.dumps({"function": name, "captured": False, "reason": str(e)}))
        return 1
    print(json.dumps({"function": name, "captured": True, "parameters": found.parameters, "digest": ir.digest(found.root), "expression": found.root.document()}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
