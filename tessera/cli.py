"""Command line: init, ingest, extract, graph, discover, score, signals, run."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys

HEAD = """# Settings with their defaults. ${NAME:-default} takes a variable of the environment.
# Sources are read only once they are enabled; user_agent has to name a contact address then.
"""

EXAMPLES = """
# known_entities:
#   - {name: "An Organisation", entity_type: organization, aliases: ["AO"]}
# sources:
#   - {name: feed, kind: rss_feed, enabled: false, side: press, feed_url: "https://...", limit: 3, attention_weight: 0.7}
#   - {name: column, kind: sitemap_column, enabled: false, side: press, sitemap_url: "https://...", url_include: "/opinion/"}
#   - {name: list, kind: listing_column, enabled: false, side: press, listing_url: "https://..."}
#   - {name: archive, kind: gob_presidency, enabled: false, side: official_government, archive_url: "https://...?page={page}", max_pages: 1}
"""


def template() -> str:
    """A whole configuration: every setting with its default, no source enabled."""
    from dataclasses import asdict

    import yaml

    from tessera.plans.config import AppConfig

    body = asdict(AppConfig())
    body["project"]["user_agent"] = "${TESSERA_USER_AGENT}"
    return HEAD + yaml.safe_dump(body, sort_keys=False, allow_unicode=True) + EXAMPLES


def _engine(path: str):
    from pyspark.sql import SparkSession

    from tessera.plans.config import load_config
    from tessera.plans.pipeline import Engine

    spark = SparkSession.builder.appName("tessera").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    return Engine(spark, load_config(path))


def _show(rows) -> None:
    from pyspark.sql import functions as F

    print(json.dumps([json.loads(r[0]) for r in rows.select(F.to_json(F.struct("*"))).collect()], ensure_ascii=False, indent=2))


def main(argv: list[str] | None = None) -> int:
    """Run one command."""
    parser = argparse.ArgumentParser(prog="tessera", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    init = commands.add_parser("init", help="write a configuration")
    init.add_argument("--to", "-d", default="config.yaml")
    init.add_argument("--overwrite", action="store_true")
    for name in ("ingest", "extract", "graph", "discover", "score", "signals", "run"):
        c = commands.add_parser(name)
        c.add_argument("--config", "-c", default="config.yaml")
        c.add_argument("--verbose", "-v", action="store_true")
        if name in ("ingest", "run"):
            c.add_argument("--landed", help="folder of JSON lines with collected documents")
        if name in ("discover", "score"):
            c.add_argument("--top", type=int, default=10)
        if name in ("discover", "signals"):
            c.add_argument("--json", action="store_true")
    args = parser.parse_args(argv)
    if args.command == "init":
        if os.path.exists(args.to) and not args.overwrite:
            print(f"{args.to} exists", file=sys.stderr)
            return 1
        os.makedirs(os.path.dirname(os.path.abspath(args.to)), exist_ok=True)
        with open(args.to, "w", encoding="utf-8") as f:
            f.write(template())
        return 0
    logging.basicConfig(level=logging.DEBUG if args.verbose else logging.INFO)
    engine = _engine(args.config)
    if getattr(args, "landed", None):
        from tessera.streaming.ingest import start

        start(engine, args.landed, f"{engine.config.project.database_path}/_stream").awaitTermination()
    if args.command == "ingest":
        landed = engine.documents().count() if args.landed else 0
        print(f"documents_collected={landed + engine.collect()}")
    elif args.command == "extract":
        print(f"documents_extracted={engine.extract()}")
    elif args.command == "graph":
        print(json.dumps(engine.map_graph()))
    elif args.command in ("discover", "score"):
        rows = engine.discover(args.top)
        if args.command == "score" or args.json:
            _show(rows)
        else:
            rows.select("entity_name", "entity_type", "bridge_score", "final_score", "status").show(args.top, False)
    elif args.command == "signals":
        for rows in engine.signals():
            _show(rows) if args.json else rows.show(20, False)
    else:
        print(json.dumps(engine.run(collect=True), ensure_ascii=False))
    return 0


if __name__ == "__main__":
    sys.exit(main())
