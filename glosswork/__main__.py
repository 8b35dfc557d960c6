"""python -m glosswork PAGES (--text T | --pattern T | --recipe FILE): searches a Parquet table of pages.

PAGES has doc_id and text, and page_index if documents have several pages; --files takes it for a folder of text files
instead, whose pages are parted by form feeds. --pattern is another name of --text.

A recipe is a JSON array of items, or an object with them under "items". An item has text (or pattern), and may have
ignore_case, label, color (name, #RRGGBB or r,g,b), opacity, selection_mode (single, best, all), select_shortest,
allow_multiple, progressive, progressive_kmax, progressive_max_gap_chars, progressive_min_total_words, regex and
literal_whitespace.

Exit codes: 0 found, 1 a phrase without a match, 2 several matches where one was asked for, 3 an unusable input.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import __version__
from .api import Session
from .operators.layout import page_maps
from .sources import pages as src
from .sources.documents import read_glyphs


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="glosswork", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("pages")
    p.add_argument("--files", action="store_true")
    p.add_argument("--version", action="version", version=f"%(prog)s {__version__}")
    what = p.add_mutually_exclusive_group()
    for name in ("--text", "--pattern", "--recipe"):
        what.add_argument(name)
    case = p.add_mutually_exclusive_group()
    case.add_argument("--ignore-case", dest="ignore_case", action="store_true", default=True)
    case.add_argument("--case-sensitive", dest="ignore_case", action="store_false")
    mode = p.add_mutually_exclusive_group()
    for name in ("best", "all", "single"):
        mode.add_argument(f"--{name}", dest="mode", action="store_const", const=name, default="best")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("-o", "--output")
    p.add_argument("--label")
    p.add_argument("--color", default="yellow")
    p.add_argument("--opacity", type=float, default=0.3)
    p.add_argument("--report", choices=["json"])
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    single = not a.recipe
    if single and not (a.text or a.pattern):
        print("glosswork: --text, --pattern or --recipe is needed", file=sys.stderr)
        return 3
    spark = SparkSession.builder.getOrCreate()
    output = a.output or f"{a.pages.rstrip('/')}.highlighted"
    try:
        if a.files:
            pages = page_maps(read_glyphs(spark, a.pages))
        else:
            pages = spark.read.parquet(a.pages)
            pages = pages if "page_index" in pages.columns else pages.withColumn("page_index", F.lit(0))
        session = Session(pages)
        if single:
            session = session.find(a.text or a.pattern, ignore_case=a.ignore_case, mode=a.mode, color=a.color, opacity=a.opacity, label=a.label)
        else:
            session = session.find_all(src.with_defaults(src.read_recipe(spark, a.recipe), a.color, a.opacity, a.label))
        context = json.dumps({"query": a.text or a.pattern, "ignore_case": a.ignore_case, "selection_mode": a.mode}, ensure_ascii=False) if single else None
        if not session.phrases:
            code, report = 0, json.dumps({"input": a.pages, "output": output, "items": []})
        else:
            whole = session.report(a.pages, output, context).first()
            code, report = whole.exit_code, whole.report
            if single and a.report:
                report = session.single_report(a.pages, output, a.dry_run, context).first().report
            if not a.dry_run:
                session.save(output)
    except Exception as e:
        print(f"glosswork: {e}", file=sys.stderr)
        return 3
    if a.report:
        print(report)
    return code


if __name__ == "__main__":
    sys.exit(main())
