"""Errors of the pipeline language, its files and its indexes. All are raised while a plan is built."""


class TrestleError(Exception):
    pass


# --- parser ---------------------------------------------------------------------------------


class ParserError(TrestleError):
    pass


class ArenaOverflow(ParserError):
    pass


class UnexpectedToken(ParserError):
    pass


class LexMalformedUtf8(ParserError):
    def __init__(self, cursor: int):
        super().__init__(f"malformed UTF-8 at byte {cursor}")
        self.cursor = cursor


class LexTokenBufferFull(ParserError):
    pass


class EmptyInput(ParserError):
    pass


class MissingSourceContext(ParserError):
    pass


class NumberOverflow(ParserError):
    pass


# --- engine ---------------------------------------------------------------------------------


class EngineError(TrestleError):
    pass


class ParseFailed(EngineError):
    pass


class ColumnNotFound(EngineError):
    def __init__(self, table: str, column: str = ""):
        super().__init__(f"table {table!r}, column {column!r}")
        self.table, self.column = table, column


class LiteralOverflow(EngineError):
    pass


class IoError(EngineError):
    pass


class PageCorrupt(EngineError):
    def __init__(self, page_index: int):
        super().__init__(f"page {page_index}")
        self.page_index = page_index


class NotImplementedStage(EngineError):
    pass


# --- ingest ---------------------------------------------------------------------------------


class IngestError(TrestleError):
    pass


class SchemaError(IngestError):
    pass


class HeaderMismatch(IngestError):
    pass


class ColumnCountMismatch(IngestError):
    def __init__(self, line: int, expected: int, found: int):
        super().__init__(f"line {line}: expected {expected} columns, found {found}")
        self.line, self.expected, self.found = line, expected, found


class NumericParse(IngestError):
    def __init__(self, line: int, column: str, value: str):
        super().__init__(f"line {line}, column {column}: {value!r}")
        self.line, self.column, self.value = line, column, value


class UnterminatedQuote(IngestError):
    def __init__(self, line: int):
        super().__init__(f"line {line}")
        self.line = line


class InvalidUtf8(IngestError):
    def __init__(self, line: int, column: str):
        super().__init__(f"line {line}, column {column}")
        self.line, self.column = line, column


class ZoneMapError(TrestleError):
    pass
