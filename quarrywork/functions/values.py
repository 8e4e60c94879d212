"""Fixed values of the classification rules: languages, file lists, name endings, ranks."""

# language: (category, extensions, file names)
LANGUAGES = {
    "typescript": ("source", ("ts", "tsx", "mts", "cts"), ()),
    "javascript": ("source", ("js", "jsx", "mjs", "cjs"), ()),
    "python": ("source", ("py", "pyi", "pyw"), ()),
    "java": ("source", ("java",), ()),
    "go": ("source", ("go",), ()),
    "rust": ("source", ("rs",), ()),
    "c": ("source", ("c", "h"), ()),
    "cpp": ("source", ("cpp", "cc", "cxx", "hpp", "hh", "hxx", "ipp", "inl"), ()),
    "csharp": ("source", ("cs",), ()),
    "objective-c": ("source", ("m", "mm"), ()),
    "swift": ("source", ("swift",), ()),
    "kotlin": ("source", ("kt", "kts"), ()),
    "scala": ("source", ("scala", "sc"), ()),
    "groovy": ("build", ("groovy", "gradle"), ()),
    "ruby": ("source", ("rb", "rake", "gemspec"), ("Gemfile", "Rakefile")),
    "php": ("source", ("php", "phtml"), ()),
    "perl": ("source", ("pl", "pm"), ()),
    "lua": ("source", ("lua",), ()),
    "dart": ("source", ("dart",), ()),
    "elixir": ("source", ("ex", "exs"), ()),
    "erlang": ("source", ("erl", "hrl"), ()),
    "haskell": ("source", ("hs", "lhs"), ()),
    "ocaml": ("source", ("ml", "mli"), ()),
    "fsharp": ("source", ("fs", "fsi", "fsx"), ()),
    "clojure": ("source", ("clj", "cljs", "cljc", "edn"), ()),
    "r": ("source", ("r",), ()),
    "julia": ("source", ("jl",), ()),
    "zig": ("source", ("zig",), ()),
    "nim": ("source", ("nim",), ()),
    "solidity": ("source", ("sol",), ()),
    "vue": ("source", ("vue",), ()),
    "svelte": ("source", ("svelte",), ()),
    "astro": ("source", ("astro",), ()),
    "shell": ("build", ("sh", "bash", "zsh", "fish"), ()),
    "powershell": ("build", ("ps1", "psm1", "psd1"), ()),
    "batch": ("build", ("bat", "cmd"), ()),
    "assembly": ("source", ("asm", "s"), ()),
    "sql": ("data", ("sql",), ()),
    "graphql": ("source", ("graphql", "gql"), ()),
    "protobuf": ("source", ("proto",), ()),
    "wasm-text": ("source", ("wat", "wast"), ()),
    "html": ("markup", ("html", "htm", "xhtml"), ()),
    "css": ("style", ("css",), ()),
    "scss": ("style", ("scss", "sass"), ()),
    "less": ("style", ("less",), ()),
    "xml": ("markup", ("xml", "xsd", "xsl", "plist"), ()),
    "svg": ("asset", ("svg",), ()),
    "markdown": ("docs", ("md", "mdx", "markdown"), ()),
    "rst": ("docs", ("rst",), ()),
    "text": ("docs", ("txt",), ("LICENSE", "AUTHORS", "CODEOWNERS", "NOTICE")),
    "json": ("config", ("json", "jsonc", "json5"), ()),
    "yaml": ("config", ("yml", "yaml"), ()),
    "toml": ("config", ("toml",), ()),
    "ini": ("config", ("ini", "cfg", "conf", "properties", "env"), ()),
    "csv": ("data", ("csv", "tsv"), ()),
    "dockerfile": ("build", ("dockerfile",), ("Dockerfile", "Containerfile")),
    "makefile": ("build", ("mk", "mak"), ("Makefile", "GNUmakefile", "makefile")),
    "cmake": ("build", ("cmake",), ("CMakeLists.txt",)),
    "nix": ("build", ("nix",), ()),
    "terraform": ("config", ("tf", "tfvars", "hcl"), ()),
}
BY_EXTENSION = {e: lang for lang, (_, extensions, _) in LANGUAGES.items() for e in extensions}
BY_NAME = {n: lang for lang, (_, _, names) in LANGUAGES.items() for n in names}
CATEGORY = {lang: category for lang, (category, _, _) in LANGUAGES.items()}
PARSERS = {
    "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "javascript", "mjs": "javascript",
    "cjs": "javascript", "py": "python", "pyi": "python", "pyw": "python", "java": "java", "go": "go", "rs": "rust",
}
PARSEABLE = (
    "typescript", "javascript", "python", "java", "go", "rust",
)
BINARY = (
    "png", "jpg", "jpeg", "gif", "webp", "avif", "ico", "icns", "bmp", "tif", "tiff", "psd", "ai", "sketch", "fig", "pdf", "doc", "docx",
    "xls", "xlsx", "ppt", "pptx", "key", "numbers", "pages", "zip", "gz", "tgz", "bz2", "xz", "7z", "rar", "tar", "zst", "lz4", "br", "jar",
    "war", "ear", "class", "dex", "apk", "aab", "ipa", "so", "dll", "exe", "dylib", "a", "lib", "o", "obj", "pdb", "bin", "dat", "img",
    "iso", "dmg", "msi", "deb", "rpm", "wasm", "node", "pyc", "pyo", "pyd", "whl", "egg", "lockb", "rlib", "woff", "woff2", "ttf", "otf",
    "eot", "mp3", "mp4", "m4a", "wav", "ogg", "oga", "flac", "aac", "webm", "mov", "avi", "mkv", "wmv", "flv", "sqlite", "sqlite3", "db",
    "mdb", "parquet", "avro", "orc", "npy", "npz", "pkl", "pickle", "h5", "hdf5", "onnx", "pt", "pth", "ckpt", "safetensors", "tflite",
    "glb", "gltf", "fbx", "blend", "stl", "3ds", "dae", "ktx2", "hdr", "exr", "swf", "jks", "keystore", "p12", "pfx", "der", "cer",
)
LOCKFILES = (
    "package-lock.json", "npm-shrinkwrap.json", "pnpm-lock.yaml", "yarn.lock", "bun.lock", "bun.lockb", "Cargo.lock", "go.sum",
    "poetry.lock", "Pipfile.lock", "uv.lock", "composer.lock", "Gemfile.lock", "mix.lock", "pubspec.lock", "Package.resolved", "flake.lock",
    "gradle.lockfile",
)
VENDOR = (
    "node_modules", "vendor", "vendors", "third_party", "third-party", "thirdparty", "external", "externals", "bower_components",
    "jspm_packages", ".yarn", "Pods", "Carthage", "site-packages", ".venv", "venv",
)
BUILD = (
    "dist", "build", "out", "target", ".next", ".nuxt", "coverage", "__generated__", "generated", "gen",
)
TEST = (
    "test", "tests", "__tests__", "spec", "specs", "__mocks__", "testing", "testdata", "fixtures", "__fixtures__", "e2e",
)
DOCS = (
    "docs", "doc", "documentation", "website", "site",
)
AUXILIARY = (
    "examples", "example", "samples", "sample", "demo", "demos", "benchmarks", "benchmark", "bench", "benches", "scripts", "script",
    "tools", "docs", "doc", "documentation", "website", "site", "playground", "playgrounds", "sandbox", "contrib", "hack", ".github",
    ".storybook", "stories",
)
CONTAINERS = (
    "packages", "crates", "apps", "libs", "modules", "services", "plugins", "extensions", "projects", "components",
)
# What the name of a generated file ends in, whatever its case; and the last word of its stem, before these extensions.
GENERATED_ENDINGS = (".min.js", ".min.css", ".min.mjs", ".map", ".snap")
GENERATED_WORDS = ("generated", "pb", "pb2", "g")
GENERATED_EXTENSIONS = ("go", "py", "ts", "js", "java", "rs", "cs")
GENERATED_EXACT_ENDINGS = ("_pb2.py", "_pb2_grpc.py")
# What marks a test: the part before the extension; ends of the stem by extension; and names that begin and end so.
TEST_PARTS = ("test", "spec", "e2e", "stories")
TEST_STEMS = {"_test": ("go", "py", "rs", "ex", "exs"), "Test": ("java", "kt", "cs"), "Tests": ("java", "kt", "cs"), "IT": ("java", "kt", "cs")}
TEST_NAMES = (("test_", ".py"),)
CATEGORY_RANK = {"source": 0, "test": 1, "config": 2, "build": 2, "style": 2, "markup": 2, "docs": 3, "data": 4, "other": 5, "asset": 6, "vendor": 7}
BYTES_PER_LINE = {
    "typescript": 34, "javascript": 32, "python": 32, "java": 38, "go": 30, "rust": 34, "c": 30, "cpp": 32, "csharp": 36, "objective-c": 36, "swift": 34,
    "kotlin": 36, "scala": 36, "ruby": 28, "php": 34, "dart": 34, "elixir": 30, "haskell": 32, "lua": 30, "shell": 30, "sql": 40, "markdown": 50, "rst": 50,
    "text": 60, "json": 26, "yaml": 24, "toml": 26, "ini": 28, "xml": 44, "html": 44, "css": 24, "scss": 24, "less": 24, "svg": 120, "csv": 48, "vue": 34,
    "svelte": 34,
}
DEFAULT_BYTES_PER_LINE = 36
# Characters that reorder text, and those that hide in it.
BIDI = (0x061C, 0x200E, 0x200F, 0x202A, 0x202B, 0x202C, 0x202D, 0x202E, 0x2066, 0x2067, 0x2068, 0x2069)
INVISIBLE = (0x115F, 0x1160, 0x200B, 0x200C, 0x200D, 0x2028, 0x2029, 0x2060, 0x2061, 0x2062, 0x2063, 0x2064, 0x3164, 0xFEFF, 0xFFA0)
# Credentials: how tokens begin, parameters that carry them, and keys of maps that do: whole, by their ending, by a part.
TOKEN_PREFIXES = ("github_pat_", "ghp_", "gho_", "ghu_", "ghs_", "ghr_")
AUTHORIZATION_SCHEMES = ("bearer", "basic")
SECRET_PARAMETERS = (
    "access_token", "refresh_token", "id_token", "token", "client_secret", "api_key", "apikey", "password", "secret", "sig", "signature",
)
SENSITIVE_KEYS = (
    "authorization", "proxy-authorization", "cookie", "set-cookie", "x-api-key", "x-auth-token", "auth", "password", "passwd", "pwd", "secret",
    "client_secret", "private_key", "privatekey",
)
SENSITIVE_ENDINGS = ("token", "secret", "password", "apikey", "api_key", "api-key", "session_id", "sessionid")
SENSITIVE_PARTS = ("credential",)
# (seconds below which the unit is used, its seconds, unit), and times with a name.
TIME_UNITS = (
    (60, 1, "second"), (3600, 60, "minute"), (86_400, 3600, "hour"), (86_400 * 30, 86_400, "day"), (86_400 * 365, 86_400 * 30, "month"), (None, 86_400 * 365, "year"),
)
NAMED_TIMES = {
    "second": {0: "now"}, "minute": {0: "this minute"}, "hour": {0: "this hour"}, "day": {-1: "yesterday", 0: "today", 1: "tomorrow"},
    "month": {-1: "last month", 0: "this month", 1: "next month"}, "year": {-1: "last year", 0: "this year", 1: "next year"},
}
# Symbol kinds in display order, with their plurals.
KIND_LABELS = {
    "class": "Classes", "interface": "Interfaces", "struct": "Structs", "trait": "Traits", "enum": "Enums", "type": "Types", "function": "Functions",
    "method": "Methods", "constant": "Constants", "variable": "Variables", "module": "Modules",
}
# Modules that come with Node.
NODE = (
    "assert", "async_hooks", "buffer", "child_process", "cluster", "console", "constants", "crypto", "dgram", "diagnostics_channel", "dns", "domain", "events",
    "fs", "http", "http2", "https", "inspector", "module", "net", "os", "path", "perf_hooks", "process", "punycode", "querystring", "readline", "repl",
    "stream", "string_decoder", "sys", "timers", "tls", "trace_events", "tty", "url", "util", "v8", "vm", "wasi", "worker_threads", "zlib",
)
# First parts of a path on the code host that are no owner.
RESERVED_OWNERS = (
    "about", "apps", "blog", "collections", "contact", "customer-stories", "enterprise", "events", "explore", "features", "issues", "login", "marketplace",
    "new", "notifications", "orgs", "organizations", "pricing", "pulls", "search", "security", "settings", "site", "sponsors", "team", "topics", "trending",
)
# Go: hosts whose modules are host/owner/repository. Rust: crates that come with the language. Java: packages that do.
GO_HOSTS = ("github.com", "gitlab.com", "bitbucket.org", "gitee.com", "codeberg.org", "git.sr.ht")
RUST_STANDARD = ("std", "core", "alloc")
JAVA_STANDARD = ("java.", "javax.", "jdk.", "sun.")
