"""Command line: validate-module, validate-content, generate-schema, generate-code, convert."""

from __future__ import annotations

import argparse
import json
import sys


def _session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("canopyql").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="canopyql")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("validate-module", "validate-content", "generate-schema", "generate-code", "convert"):
        s = sub.add_parser(name)
        s.add_argument("module")
        s.add_argument("--format", choices=("text", "json"), default="text")
        if name in ("validate-content", "convert"):
            s.add_argument("content")
            s.add_argument("--root")
        if name == "convert":
            s.add_argument("--to", choices=("xml", "json", "yaml"), required=True)
        if name == "generate-schema":
            s.add_argument("--type", choices=("json-schema", "xsd", "spark"), default="json-schema")
        if name == "generate-code":
            s.add_argument("--frozen", action="store_true")
    a = p.parse_args(argv)

    from .catalog import generate
    from .catalog.module import Loader, ModuleError

    try:
        m = Loader().load(a.module)
    except (ModuleError, OSError) as e:
        print(e, file=sys.stderr)
        return 1
    if a.command == "validate-module":
        print(json.dumps(m.stats()) if a.format == "json" else "\n".join(f"{k}: {v}" for k, v in m.stats().items()))
        return 0
    if a.command == "generate-schema":
        print({"json-schema": generate.json_schema, "xsd": generate.xsd, "spark": lambda m: "\n".join(f"{n}: {generate.spark_schema(d).simpleString()}" for n, d in m.roots().items())}[a.type](m))
        return 0
    if a.command == "generate-code":
        print(generate.python_classes(m, a.frozen))
        return 0
    from .engine import Engine
    from .operators import constraints
    from .sources import files

    eng, root = Engine(_session()), a.root or next(iter(m.roots()))
    docs = files.read_files(eng, a.content, m, root)
    if a.command == "convert":
        for r in files.convert(docs, m, root, a.to).toLocalIterator():
            print(r.content)
        return 0
    found = constraints.validate(docs, constraints.of_module(m, root)).unionByName(constraints.type_findings(docs, m, root))
    bad = docs.df.filter("error is not null").count()
    for r in found.toLocalIterator():
        print(json.dumps(r.asDict()) if a.format == "json" else f"{r.severity} {r.doc} {r.location}: {r.message}")
    return int(bad > 0 or not constraints.is_valid_set(found))


if __name__ == "__main__":
    sys.exit(main())
