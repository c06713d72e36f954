"""python -m quirelake INPUT -o OUTPUT --providers module:function [options]

``function()`` gives the ``Providers`` of a conversion: renderer, recogniser, faces, converters.
"""

from __future__ import annotations

import argparse
import importlib

from .config import Options
from .plans import convert


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="quirelake", description="Turns picture decks into editable presentations.")
    out.add_argument("input", help="folder or file that all executors reach")
    out.add_argument("-o", "--output", help="folder of the presentations (default: INPUT-decks)")
    out.add_argument("--providers", metavar="MODULE:FUNCTION")
    defaults = Options()
    out.add_argument("--dpi", type=int, default=defaults.dpi)
    out.add_argument("--lang", default=defaults.lang)
    out.add_argument("--device", choices=("auto", "cpu", "dml", "cuda"), default=defaults.device)
    out.add_argument("--pages", help="such as 1-5,8")
    out.add_argument("--min-score", type=float, default=defaults.min_score)
    out.add_argument("--font", default=defaults.font)
    for flag, text in (("fast", "the smaller recognition model"), ("keep-watermark", "leave watermarks"), ("keep-tiny-text", "convert small and blurred lines too"), ("merge-lines", "one shape for lines that go on"), ("debug", "dumps beside the output")):
        out.add_argument(f"--{flag}", action="store_true", help=text)
    out.add_argument("--no-s2t", dest="s2t", action="store_false", help="leave simplified strays")
    out.add_argument("--no-cover", dest="cover", action="store_false", help="text without fills")
    weight = out.add_mutually_exclusive_group()
    weight.add_argument("--no-bold", dest="bold_mode", action="store_const", const="never", default=defaults.bold_mode)
    weight.add_argument("--force-bold", dest="bold_mode", action="store_const", const="always")
    return out


def options_of(args: argparse.Namespace) -> Options:
    return Options(**{k: v for k, v in vars(args).items() if k in Options.__dataclass_fields__})


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    given = convert.Providers()
    if args.providers:
        module, _, name = args.providers.partition(":")
        given = getattr(importlib.import_module(module), name)()
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.getOrCreate()
    for r in convert.convert(spark, args.input, args.output or f"{args.input.rstrip('/')}-decks", options_of(args), given).orderBy("deck_id", "page_no").toLocalIterator():
        print(f"{r['deck_id']} page {r['page_no'] + 1}: {r['n_lines']} lines, {r['n_shapes']} shapes, {r['left_as_image']} left as image, {r['n_wiped']} wiped")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
