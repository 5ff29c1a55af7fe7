"""Command line: ``python -m spanloom.cli [--path P] seed|compact|api|otlp``. The path may stand in SPANLOOM_PATH."""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Sequence

from spanloom import api
from spanloom.operators.compaction import Compactor
from spanloom.session import session
from spanloom.sources import seed
from spanloom.sources.catalog import Catalog
from spanloom.sources.records import SPANS
from spanloom.sources.store import Store
from spanloom.streaming import receiver
from spanloom.streaming.ingest import Ingest
from spanloom.streaming.landing import Landing


def _address(text: str) -> tuple[str, int]:
    host, _, port = text.rpartition(":")
    return host or "127.0.0.1", int(port)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="spanloom")
    p.add_argument("--path", default=os.environ.get("SPANLOOM_PATH", "spanloom-data"), help="root of the store")
    commands = p.add_subparsers(dest="command", required=True)
    s = commands.add_parser("seed", help="write synthetic traces")
    s.add_argument("--days", type=int, default=seed.DAYS)
    s.add_argument("--traces", type=int, default=seed.TRACES_A_DAY, help="a day")
    s.add_argument("--seed", type=int, default=seed.SEED)
    commands.add_parser("compact", help="merge small files")
    for name, port in (("api", 8080), ("otlp", 4318)):
        commands.add_parser(name).add_argument("--addr", type=_address, default=("127.0.0.1", port))
    return p


def main(argv: Sequence[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    spark = spark or session()
    store = Store(spark, args.path)
    if args.command == "seed":
        print(f"{seed.seed_store(store, args.days, args.traces, args.seed)} files across {args.days} days", file=sys.stderr)
    elif args.command == "compact":
        print(Compactor(store, SPANS).run(), file=sys.stderr)
    elif args.command == "api":
        with api.server(Catalog(spark, args.path), *args.addr) as serving:
            try:
                serving.serve_forever()
            except KeyboardInterrupt:
                pass
    elif args.command == "otlp":
        landing = Landing(store.files, f"{args.path}/_landing")
        ingest = Ingest(store, landing, f"{args.path}/_checkpoint")
        ingest.start()
        with receiver.server(landing, *args.addr) as serving:
            try:
                serving.serve_forever()
            except KeyboardInterrupt:
                ingest.drain()
    return 0


if __name__ == "__main__":
    sys.exit(main())
