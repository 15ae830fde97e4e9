"""Write biotally/registry/float_columns.py: the double columns of every registered query that has an oracle.

Both sides give these columns nine significant digits, so that equal results are equal values.
usage: python tools/float_columns.py [--sf DIR]
"""

from __future__ import annotations

import argparse
import os
import pprint
import sys

import duckdb

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

from biotally.registry import core, load  # noqa: E402


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.001")
    sf = ap.parse_args().sf
    load()
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{sf}/{f}')")
    out = {}
    for name, sql in core.RAW_ORACLES.items():
        cols = [r[0] for r in con.execute(f"describe {sql}").fetchall() if r[1] == "DOUBLE"]
        if cols:
            out[name] = tuple(cols)
    path = os.path.join(os.path.dirname(core.__file__), "float_columns.py")
    with open(path, "w") as fh:
        fh.write('"""Double columns of the registered queries; written by tools/float_columns.py."""\n\nFLOAT_COLUMNS = ' + pprint.pformat(out, width=150) + "\n")
    print(len(out), "queries with double columns")


if __name__ == "__main__":
    main()
