"""Command line: python -m lexiloom MODULE ..."""

from __future__ import annotations

import argparse
import logging
import sys

from . import __version__

log = logging.getLogger("lexiloom")


def _spark(args: argparse.Namespace):
    from .runtime import findable, session

    spark = session("lexiloom", args.processes or "*")
    findable(spark)
    return spark


def _corpus(spark, path: str):
    from pyspark.sql import functions as F

    from .plans.pipeline import Corpus
    from .sources import readers

    name = F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)
    files = spark.read.text(path, wholetext=True).select(name.alias("name"), F.col("value").alias("payload"))
    docs = readers.text_documents(files.select(F.col("name").alias("doc_id"), "payload"))
    return Corpus(docs.select("doc_id", F.col("doc_id").alias("name"), F.col("payload").alias("content")))


def _done(df, out: str) -> None:
    df.write.mode("overwrite").json(out)
    log.info("written to %s", out)


def tagger(args: argparse.Namespace) -> None:
    """Runs a master file's pipeline over text files and writes what it exports."""
    from .plans.pipeline import load_master

    pipeline, _ = load_master(args.master)
    log.info("modules: %s", ", ".join(n for n, *_ in pipeline))
    _done(pipeline(_corpus(_spark(args), args.infile)), args.outfile)


def enrich(args: argparse.Namespace) -> None:
    """Adds the features of a description file to CoNLL files."""
    from .functions import compile_xml
    from .plans.modules import _lines
    from .sources import readers, sinks

    spark = _spark(args)
    e = compile_xml.read_enrichment(args.infofile)
    names = args.fields.split(",")
    tokens = readers.conll_tokens(_lines(spark, args.infile), names, names[0])
    _done(sinks.conll(compile_xml.enrich(tokens, e, args.mode), e.visible(args.mode)), args.outfile)


def evaluate(args: argparse.Namespace) -> None:
    """Precision, recall and F of the tags in two folders of files."""
    from .plans.modules import evaluated

    evaluated(_spark(args), args.reference, args.guess, args.format, args.guess_format, column=args.column, fields=args.fields).orderBy("entity").show(1000, truncate=False)


def compile_dictionary(args: argparse.Namespace) -> None:
    """Turns a text file of entries (a tab before what they map to) into a lexicon table."""
    from pyspark.sql import functions as F

    from .plans.modules import compiled

    cells = F.split("value", "\t")
    entries = _spark(args).read.text(args.infile).select(F.get(cells, F.lit(0)).alias("entry"), F.get(cells, F.lit(1)).alias("mapped"))
    compiled(entries, args.kind, nocase=args.nocase).write.mode("overwrite").parquet(args.outfile)
    log.info("written to %s", args.outfile)


def decompile_dictionary(args: argparse.Namespace) -> None:
    """Turns a lexicon table back into a text file of entries."""
    from pyspark.sql import functions as F

    from .plans.modules import decompiled

    d = decompiled(_spark(args).read.parquet(args.infile))
    d.select(F.concat_ws("\t", *d.columns).alias("value")).write.mode("overwrite").text(args.outfile)


def modules(args: argparse.Namespace) -> None:
    """Names the modules a pipeline may hold, and what comes with them."""
    from .operators.segment import TOKENISERS
    from .plans.modules import DOCUMENT_FILTERS, TAG_FILTERS, TAG_READERS
    from .plans.pipeline import MODULES
    from .sources.sinks import EXPORTERS

    for title, names in (("modules", MODULES), ("tokenisers", TOKENISERS), ("exporters", EXPORTERS), ("readers of tags", TAG_READERS), ("document filters", DOCUMENT_FILTERS), ("tag filters", TAG_FILTERS)):
        print(f"{title}: {', '.join(sorted(names))}")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lexiloom", description=__doc__)
    p.add_argument("--version", action="version", version=__version__)
    p.add_argument("-v", "--verbose", action="count", default=0, help="say more; twice for everything")
    p.add_argument("-p", "--processes", type=int, default=0, help="cores to use, 0 for all")
    subs = p.add_subparsers(dest="module", required=True)

    def sub(f, *arguments: tuple) -> None:
        s = subs.add_parser(f.__name__, help=f.__doc__.splitlines()[0])
        for names, options in arguments:
            s.add_argument(*names, **options)
        s.set_defaults(run=f)

    arg = lambda *names, **options: (names, options)
    sub(tagger, arg("master"), arg("infile"), arg("outfile"))
    sub(enrich, arg("infile"), arg("infofile"), arg("outfile"), arg("--fields", default="word", help="names of the input's columns"), arg("-m", "--mode", default="label", choices=["train", "label"]))
    sub(evaluate, arg("reference"), arg("guess"), arg("-f", "--format", default="conll"), arg("--guess-format"), arg("--column", type=int, default=-1), arg("--fields", type=int, default=2))
    sub(compile_dictionary, arg("infile"), arg("outfile"), arg("-k", "--kind", default="token", choices=["token", "multiword", "map"]), arg("--nocase", action="store_true"))
    sub(decompile_dictionary, arg("infile"), arg("outfile"))
    sub(modules)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=[logging.WARNING, logging.INFO, logging.DEBUG][min(args.verbose, 2)], format="%(levelname)s\t%(asctime)s\t%(name)s\t%(message)s")
    args.run(args)
    return 0


if __name__ == "__main__":
    sys.exit(main())
