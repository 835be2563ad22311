"""Exceptions, by layer: data, formula, model."""

from __future__ import annotations


class StatError(Exception):
    """Any error of this library."""


class DataError(StatError):
    pass


class DimensionMismatch(DataError):
    def __init__(self, expected: object, actual: object):
        super().__init__(f"dimension mismatch: expected {expected}, got {actual}")
        self.expected, self.actual = expected, actual


class ColumnNotFound(DataError):
    def __init__(self, name: str):
        super().__init__(f"no column named {name!r}")
        self.name = name


class DuplicateColumn(DataError):
    def __init__(self, name: str):
        super().__init__(f"column {name!r} occurs twice")
        self.name = name


class IndexOutOfBounds(DataError):
    def __init__(self, index: int, length: int):
        super().__init__(f"index {index} is outside {length} rows")
        self.index, self.length = index, length


class TypeMismatch(DataError):
    def __init__(self, what: str, expected: str, actual: str):
        super().__init__(f"{what}: expected {expected}, found {actual}")
        self.expected, self.actual = expected, actual


class NonNumericData(DataError):
    pass


class MissingData(DataError):
    pass


class InvalidParameter(DataError):
    pass


class FormulaError(StatError):
    pass


class FormulaSyntaxError(FormulaError):
    def __init__(self, position: int, message: str, context: str = ""):
        super().__init__(f"at {position}: {message}" + (f" near {context!r}" if context else ""))
        self.position, self.context = position, context


class VariableNotFound(FormulaError):
    def __init__(self, variable: str, available: list[str]):
        super().__init__(f"variable {variable!r} not found; there are {', '.join(available) or 'none'}")
        self.variable, self.available = variable, available


class VariableTypeMismatch(FormulaError):
    def __init__(self, variable: str, expected: str, actual: str):
        super().__init__(f"variable {variable!r}: expected {expected}, found {actual}")
        self.variable, self.expected, self.actual = variable, expected, actual


class FunctionError(FormulaError):
    def __init__(self, function: str, message: str, argument: str | None = None):
        super().__init__(f"{function}({argument or ''}): {message}")
        self.function, self.argument = function, argument


class InteractionError(FormulaError):
    pass


class InvalidStructure(FormulaError):
    pass


class MissingResponse(FormulaError):
    pass


class NumericalError(FormulaError):
    def __init__(self, operation: str, message: str):
        super().__init__(f"{operation}: {message}")
        self.operation = operation


class ModelError(StatError):
    pass


class NotFitted(ModelError):
    pass


class InsufficientData(ModelError):
    def __init__(self, rows: int, parameters: int):
        super().__init__(f"{rows} rows for {parameters} parameters")
        self.rows, self.parameters = rows, parameters


class SingularMatrixError(ModelError):
    def __init__(self, aliased: list[str]):
        super().__init__(f"the design matrix is singular; linearly dependent: {', '.join(aliased)}. With all levels of a factor, use '0 +'")
        self.aliased = aliased


class NotConverged(ModelError):
    pass


class InvalidConfig(ModelError):
    pass


class PredictionError(ModelError):
    pass


class MissingDataError(ModelError):
    pass
