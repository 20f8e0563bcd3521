"""Languages by file name and extension."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codehealth.functions.paths import extension, extension_col, file_name, name_col

# Languages of extensions and of file names.
EXTENSIONS = {
    "zig": "zig", "zon": "zig", "rs": "rust", "py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript",
    "ts": "typescript", "tsx": "typescript", "mts": "typescript", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "cc": "cpp", "cxx": "cpp",
    "hxx": "cpp", "cs": "c_sharp", "java": "java", "kt": "kotlin", "kts": "kotlin", "scala": "scala", "go": "go", "swift": "swift",
    "rb": "ruby", "erb": "ruby", "php": "php", "ex": "elixir", "exs": "elixir", "erl": "erlang", "hrl": "erlang", "hs": "haskell",
    "lua": "lua", "pl": "perl", "pm": "perl", "sh": "bash", "bash": "bash", "zsh": "bash", "html": "html", "htm": "html", "css": "css",
    "scss": "scss", "sass": "scss", "less": "css", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "xml": "xml", "csv": "csv",
    "ini": "ini", "env": "dotenv", "md": "markdown", "rst": "markdown", "txt": "text", "makefile": "makefile", "cmake": "cmake", "sql": "sql",
    "proto": "protobuf", "dockerfile": "dockerfile", "nix": "nix", "dart": "dart", "jl": "julia", "r": "r", "R": "r", "nim": "nim",
    "cr": "crystal", "v": "v", "ml": "ocaml", "mli": "ocaml", "fs": "f_sharp", "fsi": "f_sharp", "clj": "clojure", "cljs": "clojure",
    "groovy": "groovy", "sol": "solidity", "gd": "gdscript", "glsl": "glsl", "vert": "glsl", "frag": "glsl", "hcl": "hcl", "tf": "hcl",
    "vue": "vue", "svelte": "svelte", "m": "objectivec", "mm": "objectivec", "pas": "pascal", "pp": "pascal", "asm": "assembly", "s": "assembly",
    "cob": "cobol", "ps1": "powershell",
}
FILE_NAMES = {
    "Makefile": "makefile", "Dockerfile": "dockerfile", "Gemfile": "ruby", "Rakefile": "ruby", "CMakeLists.txt": "cmake", "Cargo.toml": "toml",
    "build.zig": "zig", "build.zig.zon": "zig", "Justfile": "just",
}
DATA_LANGUAGES = ("unknown", "text", "json", "yaml", "toml", "xml", "csv", "ini", "dotenv")
IMPORT_LANGUAGES = ("zig", "rust", "python", "javascript", "typescript", "go", "c", "cpp")
#: Extensions that an import may leave out, in the order they are tried.
SOURCE_EXTENSIONS = (
    ".zig", ".rs", ".py", ".pyi", ".js", ".jsx", ".mjs", ".ts", ".tsx", ".mts", ".go", ".c", ".h", ".cpp", ".hpp", ".cc", ".cxx", ".hxx", ".m", ".mm",
)
EXCLUDED_DIRS = (
    ".git", ".hg", ".svn", "node_modules", "__pycache__", ".pytest_cache", "target", "build", "dist", ".zig-cache", "zig-out", ".cargo",
    ".gradle", ".maven", "vendor", ".bundle", "Pods", ".terraform", ".vagrant", "elm-stuff", ".tox", "coverage", ".nyc_output",
    "__snapshots__", ".DS_Store",
)


def language_of(path: str) -> str:
    """The language of a file, ``unknown`` for names and extensions that none has."""
    name = file_name(path)
    return FILE_NAMES.get(name) or EXTENSIONS.get(extension(path), "unknown")


def import_language(path: str) -> str | None:
    """The language, if imports can be read from it."""
    found = language_of(path)
    return found if found in IMPORT_LANGUAGES else None


def is_source(path: str) -> bool:
    return language_of(path) not in DATA_LANGUAGES


def language_col(path: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(FILE_NAMES), name_col(path)), F.try_element_at(literal_map(EXTENSIONS), extension_col(path)), F.lit("unknown"))


def literal_map(table: dict[str, str]) -> Column:
    return F.map_from_arrays(F.array(*map(F.lit, table)), F.array(*map(F.lit, table.values())))
