"""Words that the languages reserve."""

# The word kinds the languages reserve for block headers.
GO_CONTROL = ("if", "for", "switch", "select")
JS_CONTROL = ("if", "for", "while", "switch", "with")
JS_TYPE_WORDS = ("class", "interface", "enum", "namespace", "module")
# Words after which Go ends a statement at a newline.
GO_LINE_ENDERS = ("return", "break", "continue", "fallthrough", "++", "--", ")", "]", "}")
GO_KEYWORDS = (
    "break", "case", "chan", "const", "continue", "default", "defer", "else",
    "fallthrough", "for", "func", "go", "goto", "if", "import", "interface", "map",
    "package", "range", "return", "select", "struct", "switch", "type", "var",
)
