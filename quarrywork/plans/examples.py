"""Queries over functions of single texts, checked against typed examples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import paths as P
from ..functions import text as X
from .registry import by_example, query, typed

joined = lambda array, of: F.array_join(F.transform(array, of), ",")
number = lambda f: lambda c: f(c.cast("double"))

by_example("first_line", [
    ("one\ntwo", "one"), ("a \t b\r\nc", "a b"), ("x" * 70, "x" * 59 + "…"), ("\x07be\x1bll", "bell"), ("", ""), ("  lead\rtail", "lead"), ("y" * 60, "y" * 60),
], lambda c: X.clean_single_line(X.first_line(c), 60))
by_example("truncate", [("abcdef", "abcd…"), ("abcde", "abcde"), ("", "")], lambda c: X.truncate(c, 5))
by_example("normalize_iso_date", [
    ("2024-01-05T10:00:00+02:00", "2024-01-05T08:00:00.000Z"), ("2024-02-30", None), ("2024-01-05", "2024-01-05T00:00:00.000Z"), ("", None), ("soon", None),
    ("2023-12-31T23:59:59.5Z", "2023-12-31T23:59:59.500Z"), ("2" * 65, None),
], X.normalize_iso_date)
by_example("normalize_signature", [("f(a,\n  b)", "f(a, b)"), ("  ", None), ("s" * 161, "s" * 159 + "…"), ("s" * 160, "s" * 160)], X.normalize_signature)
by_example("redact_secrets", [
    ("ghp_a1 and github_pat_b2_c", "[REDACTED] and [REDACTED]"), ("Authorization: Bearer abc.def-g, next", "Authorization: Bearer [REDACTED], next"), ("basic  Zm9v;", "basic  [REDACTED];"),
    ("https://x.org/?access_token=abc123&a=1", "https://x.org/?access_token=[REDACTED]&a=1"), ("https://u:pw@host.org/", "https://[REDACTED]@host.org/"), ("password=hunter2", "password=[REDACTED]"),
    ("?sig=aa#b refresh_token=cc", "?sig=[REDACTED]#b refresh_token=[REDACTED]"), ("token abcdefgh12345678", "token abcdefgh12345678"), ("nothing at all", "nothing at all"),
    ("the key is s3cr3t-l1teral!", "the key is [REDACTED]"),
], lambda c: X.redact_secrets(c, ("s3cr3t-l1teral!", "short")), around=True)
by_example("redact_map", [
    ("githubToken=abc", "[REDACTED]"), ("tokenizer=abc", "abc"), ("auth=abc", "abc".replace("abc", "[REDACTED]")), ("author=abc", "abc"), ("pwd=a", "[REDACTED]"), ("private_key=a", "[REDACTED]"),
    ("awsCredentials=a", "[REDACTED]"), ("session_id=a", "[REDACTED]"), ("x-api-key=12", "12"), ("tokenConfigured=true", "true"), ("note=ghp_a1", "[REDACTED]"), ("Set-Cookie=a", "[REDACTED]"),
], lambda c: F.element_at(F.map_values(X.redact_map(F.create_map(F.substring_index(c, "=", 1), F.substring_index(c, "=", -1)))), 1))
by_example("hidden_characters", [
    ("a‮b⁦", "1:U+202E:bidi,3:U+2066:bidi"), ("plain", ""), ("a‌b", "1:U+200C:invisible"), ("क‌ष", ""), ("\U0001f469‍\U0001f4bb", ""),
    ("\U0001f469‍b", "1:U+200D:invisible"), ("﻿x​ㅤ", "0:U+FEFF:invisible,2:U+200B:invisible,3:U+3164:invisible"), ("؜ ", "0:U+061C:bidi,1:U+2028:invisible"),
], lambda c: joined(X.hidden_characters(c), lambda h: F.concat_ws(":", h["place"], h["code_point"], h["kind"])))
by_example("escape_hidden", [("a‮b", "a[U+202E]b"), ("x‍y", "x[U+200D]y"), ("क‍ष", "क‍ष"), ("plain", "plain")], X.escape_hidden, around=True)
by_example("initials", [("Ada Lovelace", "AL"), ("octocat", "OC"), ("jean-luc.picard", "JP"), ("a_b c", "AC"), ("  ", "?"), ("Q", "Q")], X.initials)
by_example("format_compact", [("999", "999"), ("1000", "1K"), ("238421", "238.4K"), ("999950", "1M"), ("1500000000", "1.5B"), ("12.34", "12.3")], number(X.format_compact))
by_example("format_integer", [("12482", "12,482"), ("0.5", "1"), ("1234567.4", "1,234,567")], number(X.format_integer))
by_example("format_percent", [("0.4812", "48%"), ("0.001", "<1%"), ("0", "0%"), ("0.125", "13%"), ("1", "100%")], number(X.format_percent))
by_example("format_bytes", [
    ("0", "0 B"), ("1023", "1023 B"), ("1024", "1.0 KB"), ("10239", "10.0 KB"), ("15872", "16 KB"), ("1048576", "1.0 MB"), ("2199023255552", "2.0 TB"), ("5497558138880000", "5000 TB"),
], lambda c: X.format_bytes(c.cast("long")))
by_example("pluralize", [("1", "1 file"), ("0", "0 files"), ("1200", "1,200 files")], lambda c: X.pluralize(c.cast("long"), "file"))
by_example("format_relative_time", [
    ("0", "now"), ("-1000", "1 second ago"), ("-59000", "59 seconds ago"), ("-180000", "3 minutes ago"), ("3600000", "in 1 hour"), ("-86400000", "yesterday"), ("86400000", "tomorrow"),
    ("-259200000", "3 days ago"), ("-2600000000", "last month"), ("7800000000", "in 3 months"), ("40000000000", "next year"), ("-70000000000", "2 years ago"), (None, "unknown"),
], lambda c: X.format_relative_time(F.timestamp_millis(c.cast("long")), F.timestamp_millis(F.lit(0))))
by_example("format_date", [("2024-01-05T23:00:00Z", "Jan 5, 2024"), ("1999-12-31", "Dec 31, 1999"), ("x", "unknown")], lambda c: X.format_date(F.try_to_timestamp(c)))
by_example("kind_labels", [("class", "class:Classes:1"), ("method", "method:Methods:8"), ("module", "module:Modules:11"), ("other", "")], lambda c: F.concat_ws(":", *X.kind_labels(c)))
by_example("line_metrics", [
    ("a\tb\nabcdefghi", "2:9"), ("", "0:0"), ("\n", "1:0"), ("\t\tx\r\nyy\r", "2:9"), ("﻿abc", "1:3"), ("w" * 4000, "1:3000"),
], lambda c: F.concat_ws(":", F.size(X.source_lines(c)), X.max_visual_width(c)))
by_example("parse_eligible", [
    ("// @flow\nx", "true:true"), ("#!/bin/x\n/* a\n@noflow */ y", "true:true"), ("x // @flow", "true:false"), ("/* open @flow", "true:true"), ("é" * 40, "false:false"), ("// @flowers", "true:false"),
], lambda c: F.concat_ws(":", X.parse_eligible(c, 64).cast("string"), X.has_flow_pragma(c).cast("string")))
by_example("npm_names", [
    ("fs/promises", "node:fs::"), ("node:path", "node:path::"), ("@scope/p/sub/x", "@scope/p:@scope/p:sub/x"), ("lodash/fp", "lodash:lodash:fp"), ("react", "react:react:"), ("@/x", "::"), ("~/x", "::"),
    ("#x", "::"), ("./x", "::"), ("npm:react@18/jsx", "react::"), ("jsr:@std/path@1", "jsr:@std/path::"), ("https://deno.land/x/y.ts", "deno.land::"), ("virtual:pwa/x", "virtual:pwa::"),
], lambda c: F.concat_ws(":", F.coalesce(N.external_package(c), F.lit("")), F.coalesce(F.when(N.node_builtin(c).isNull(), N.npm_package(c)), F.lit("")), F.coalesce(F.when(N.node_builtin(c).isNull(), N.npm_subpath(c)), F.lit(""))))
by_example("external_module_name", [
    ("go github.com/a/b/c", "github.com/a/b"), ("go golang.org/x/net/html", "golang.org/x/net"), ("go go.uber.org/zap/v2/x", "go.uber.org/zap/v2"), ("go net/http", "net/http"), ("java org.junit.Test", "org.junit"),
    ("rust core::fmt", "std"), ("rust serde::de::X", "serde"), ("python os.path", "os"), ("typescript react/jsx", "react"),
], lambda c: N.external_module(F.substring_index(c, " ", -1), F.substring_index(c, " ", 1)))
by_example("map_use_tree", [
    ("a::{b, c::{d, self}}", "a::b,a::c::d,a::c"), ("std::io", "std::io"), ("a::b as c", "a::b"), ("{a, b::{c, d::{e, f}, g}}", "a,b::c,b::d::e,b::d::f,b::g"), ("a::{self, b as x, *};", "a,a::b,a::*"),
    ("crate::x::{}", ""),
], lambda c: F.array_join(N.map_use_tree(c), ","))
by_example("classify_repo_url", [
    ("https://github.com/o/r.git", "ok|o|r||"), ("git@github.com:o/r1.git", "ok|o|r1||"), ("github.com/about/x", "invalid-owner||||"), ("https://github.com/o/r/tree/main/src/a.ts", "ok|o|r|main|src/a.ts"),
    ("https://github.com/o", "missing-repo||||"), ("  ", "empty||||"), ("http://x.com/a/b", "not-github||||"), ("o/r", "ok|o|r||"), ("https://u:p@github.com/a/b", "not-github||||"), ("a--b/c", "invalid-owner||||"),
    ("o/..", "invalid-repo||||"), ("https://github.com/o/r%2", "not-github||||"), ("https://github.com:8080/o/r", "not-github||||"), ("https://GitHub.com/O/R/blob/v1/a%20b?x", "ok|O|R|v1|a b"),
    ("www.github.com/o/r/commit/../x", "ok|o|r||"), ("just words", "not-github||||"),
], lambda c: (lambda s: F.array_join(F.array(*[F.coalesce(s[k], F.lit("")) for k in ("reason", "owner", "repo", "ref", "path")]), "|"))(N.classify_repo_url(c)), "pages", "page_id")
by_example("safe_urls", [
    ("https://avatars.githubusercontent.com/u/1|dependabot[bot]|https://github.com/o/r/commit/ab", "https://avatars.githubusercontent.com/u/1|https://github.com/apps/dependabot|https://github.com/o/r/commit/ab"),
    ("https://evil.org/u/1|a b|https://evil.org/o/r/commit/ab", "|https://github.com/a%20b|https://github.com/o/r/commit/s%2F1"),
    ("http://avatars.githubusercontent.com/u|ada|", "|https://github.com/ada|https://github.com/o/r/commit/s%2F1"),
], lambda c: F.concat_ws("|", F.coalesce(N.safe_avatar(F.split_part(c, F.lit("|"), F.lit(1))), F.lit("")), N.profile_url(F.split_part(c, F.lit("|"), F.lit(2))), N.commit_url(F.split_part(c, F.lit("|"), F.lit(3)), F.lit("https://github.com/o/r"), F.lit("s/1"))))
by_example("classify_names", [
    ("src/a.ts", "typescript:typescript:source:false:false"), ("src/a.test.tsx", "typescript:tsx:test:false:false"), ("pkg/x.pb.go", "go:go:source:true:false"), ("a/test_x.py", "python:python:test:false:false"),
    ("a/FooIT.java", "java:java:test:false:false"), ("latest.go", "go:go:source:false:false"), ("a_test.rs", "rust:rust:test:false:false"), ("docs/site.css", "css:-:docs:false:false"), ("docs/a.py", "python:python:source:false:false"),
    ("README", "unknown:-:docs:false:false"), ("Changelog.old", "unknown:-:docs:false:false"), (".env", "unknown:-:config:false:false"), ("vite.config.ts", "typescript:typescript:source:false:false"),
    (".eslintrc.json", "json:-:config:false:false"), ("package-lock.json", "json:-:config:true:false"), ("x.min.JS", "javascript:javascript:source:true:false"), ("node_modules/a/b.js", "javascript:javascript:vendor:true:false"),
    ("img/logo.PNG", "unknown:-:asset:false:true"), ("dist/a.js", "javascript:javascript:build:false:false"), ("Dockerfile.dev", "dockerfile:-:build:false:false"), ("Makefile", "makefile:-:build:false:false"),
    ("a.generated.cs", "csharp:-:source:true:false"), ("s_pb2_grpc.py", "python:python:source:true:false"), ("x.snap", "unknown:-:other:true:false"), ("data.csv", "csv:-:data:false:false"), ("babelrc", "unknown:-:config:false:false"),
    ("a/fixtures/x.json", "json:-:test:false:false"), ("LICENSE", "text:-:docs:false:false"), ("x.stories.jsx", "javascript:javascript:test:false:false"), ("noext", "unknown:-:other:false:false"),
], lambda c: F.concat_ws(":", P.detect_language(c), F.coalesce(P.parser_language(c), F.lit("-")), P.detect_category(c, P.detect_language(c)), P.is_generated_path(c).cast("string"), P.is_binary_path(c).cast("string")))
by_example("join_path", [
    ("a/b|./c", "a/b/c"), ("a/b|../c", "a/c"), ("a|../../c", None), ("|x//y/.", "x/y"), ("a/b|/c/d", "c/d"), ("a/b|..", "a"), ("a|..", ""), ("a|b/../../c/./d", "c/d"),
], lambda c: P.join_path(F.substring_index(c, "|", 1), F.substring_index(c, "|", -1)))
by_example("relative_to", [("a/b/c.ts|a", "b/c.ts"), ("a/b|", "a/b"), ("a/b|a/b", "")], lambda c: P.relative_to(F.substring_index(c, "|", 1), F.substring_index(c, "|", -1)))
IDS = [
    ("file:a/b.ts", "a/b.ts|file"), ("dir:", "|directory"), ("dir:a", "a|directory"), ("sym:a/b.ts#f#g@3", "a/b.ts#f|symbol"), ("user:ada", "-|contributor"), ("author:ada l", "-|contributor"), ("import:file:a->file:b", "-|edge"),
]
by_example("parse_ids", IDS, lambda c: F.concat_ws("|", F.coalesce(P.path_from_id(c), F.lit("-")), P.kind_from_id(c)))
query("edge_ids", "SELECT DISTINCT repo_id, concat(kind, ':file:', path, '->file:', specifier) AS id FROM fx_imports")(
    lambda v: v("fx_imports").select("repo_id", P.edge_id(F.col("kind"), P.file_id(F.col("path")), P.file_id(F.col("specifier"))).alias("id")).distinct())
query("reveal_path", f"SELECT doc_id, {typed(['', 'a', 'a,a/b', 'a,a/b,a/b/c'], 'doc_id')} AS chain FROM fx_docs")(
    lambda v: v("fx_docs").select("doc_id", F.array_join(P.reveal_path(F.element_at(F.array(*map(F.lit, ("x", "a/x", "a/b/x", "a/b/c/x"))), (F.col("doc_id") % 4 + 1).cast("int"))), ",").alias("chain")))
