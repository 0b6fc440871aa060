"""Text functions that Spark has not under one name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(text: Column) -> Column:
    """Without white space at both ends (trim alone leaves tabs and line feeds)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def tokens(text: Column, longest: int = 40) -> Column:
    """Lower-cased runs of letters and digits; tokens of over `longest` bytes are dropped."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1), lambda t: F.octet_length(t) <= longest)


def utf8_prefix(text: Column, n: int) -> Column:
    """The longest prefix of at most n bytes that ends at a character's end."""
    ascii_or_short = F.octet_length(text) == F.length(text)
    # Characters are at most four bytes: cut to n of them, then drop from the end what is over n bytes.
    some = F.substring(text, 1, n)
    sizes = F.transform(F.split(some, ""), F.octet_length)
    fitting = F.aggregate(sizes, F.struct(F.lit(0).alias("bytes"), F.lit(0).alias("n")), lambda a, s: F.when(a["bytes"] + s <= n, F.struct((a["bytes"] + s).alias("bytes"), (a["n"] + 1).alias("n"))).otherwise(F.struct(F.lit(2**30).alias("bytes"), a["n"].alias("n"))))["n"]
    return F.when(ascii_or_short, some).otherwise(F.substring(some, F.lit(1), fitting))


def node_type(name: Column) -> Column:
    """A node type from its written form: any case, `doc` for document, others as they are, lower-cased."""
    low = F.lower(name)
    return F.when(low == "doc", "document").otherwise(low)


#: File extensions by kind of content.
CODE_EXTENSIONS = (
    "rs py js ts jsx tsx go java c cpp h hpp rb php swift kt scala cs fs ex exs clj cljs hs ml mli lua r jl sh bash zsh fish ps1 vim el sql graphql proto "
    "yaml yml toml json xml html css scss sass less dockerfile makefile cmake gradle zig nim v d sol move cairo wasm wat"
).split()
IMAGE_EXTENSIONS = "png jpg jpeg gif webp bmp svg ico tiff".split()
#: Strings that mark a line as code.
CODE_MARKS = (
    "fn ", "def ", "func ", "function ", "class ", "struct ", "impl ", "pub fn", "async fn", "const ", "let ", "var ", "import ", "from ", "package ",
    "#include", "#define", "using namespace", "module ", "pub mod", "pub struct", "pub enum", "interface ", "type ", "export ", "require(", "console.log",
    "print(", "println!", "if __name__", "#!/", "// ", "/* ", "/// ", "#[", "@",
)


def content_type_of_extension(extension: Column) -> Column:
    low = F.lower(extension)
    return F.when(low.isin(CODE_EXTENSIONS), "code").when(low.isin(IMAGE_EXTENSIONS), "image").otherwise("text")


def content_type_of_text(text: Column, lines: int = 20, share: float = 0.3) -> Column:
    """Code if over a share of the first lines look like code, else text."""
    head = F.slice(F.split(text, "\n"), 1, lines)

    def is_code(line: Column) -> Column:
        bare = strip(line)
        found = bare.endswith("{") | bare.endswith(";") | bare.startswith("}")
        for mark in CODE_MARKS:
            found = found | F.contains(line, F.lit(mark))
        return found

    return F.when((F.length(text) > 0) & (F.size(F.filter(head, is_code)) > F.lit(share) * F.size(head)), "code").otherwise("text")
