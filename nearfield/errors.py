"""Errors of the vector engine."""


class VectorError(Exception):
    """Base of all errors raised by the engine."""


class NotFound(VectorError):
    def __init__(self, record_id: str):
        super().__init__(f"Record not found: {record_id}")
        self.record_id = record_id


class DimensionMismatch(VectorError):
    def __init__(self, expected: int, actual: int):
        super().__init__(f"Dimension mismatch: expected {expected}, got {actual}")
        self.expected, self.actual = expected, actual


class EmptyVector(VectorError):
    def __init__(self) -> None:
        super().__init__("Empty vector")


class Other(VectorError):
    pass


class FilterParseError(Other):
    def __init__(self, why: str):
        super().__init__(f"filter parse error: {why}")
