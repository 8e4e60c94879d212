"""Lines with several import statements, or several targets in one."""

from quarrywork.operators import resolve as D

CASES = [
    ("python", "import os, sys.path as p; import re", [("import", "os", []), ("import", "sys.path", []), ("import", "re", [])]),
    ("python", "from .m import x, y as z; from . import (q)", [("import", ".m", ["x", "y"]), ("import", ".", ["q"])]),
    ("python", "    from a.b import *  # all", [("import", "a.b", ["*"])]),
    ("typescript", 'import a from "x"; import b, { c as d, type E } from "y"', [("import", "x", ["default"]), ("import", "y", ["default", "c", "E"])]),
    ("javascript", "import * as n from 'x';import 'y'", [("import", "x", ["*"]), ("import", "y", [])]),
    ("tsx", "import type { A } from 'x'; export * from 'y'; export { b as c } from 'z';", [("import", "x", ["A"]), ("re-export", "y", ["*"]), ("re-export", "z", ["b"])]),
    ("javascript", "const a = require('x'), b = require('y'); await Promise.all([import('u'), import('v')])", [("require", "x", []), ("require", "y", []), ("dynamic-import", "u", []), ("dynamic-import", "v", [])]),
    ("javascript", "const s = 1; // nothing", []),
    ("go", 'import f "fmt"; import "os"', [("import", "fmt", []), ("import", "os", [])]),
    ("go", 'import ("a"; b "c/d")', [("import", "a", []), ("import", "c/d", [])]),
    ("java", "import a.B; import static c.D.*;", [("import", "a.B", ["B"]), ("import", "c.D.*", ["*"])]),
    ("rust", "use a::b; pub use c::*; mod d;", [("use", "a::b", ["b"]), ("use", "c::*", ["*"]), ("mod", "d", [])]),
]


def test_every_statement_and_target_of_a_line(spark):
    df = spark.createDataFrame([("r", str(i), language, f"\n{code}\n") for i, (language, code, _) in enumerate(CASES)], ["repo_id", "path", "language", "text"])
    got = {}
    for r in D.extract_import_refs(df).collect():
        assert r.line == 2
        got.setdefault(int(r.path), []).append((r.kind, r.specifier, r.names))
    for i, (_, code, want) in enumerate(CASES):
        assert sorted(got.get(i, [])) == sorted(want), code
