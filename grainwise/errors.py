"""The ways a request can be refused."""


class ContractError(ValueError):
    """The contract is incomplete, contradicts itself, or does not fit the table."""


class ScopeError(ValueError):
    """The contract describes rows that cannot be selected."""


class ParamsInvalid(ValueError):
    """The caller's arguments are wrong, as opposed to the contract's answer."""


class NotPossible(ValueError):
    """The declared measure or dimension cannot answer this question."""


class TooManyGroups(NotPossible):
    """More groups than a column-per-group table can show."""


class LostRows(ScopeError):
    """An output does not add back to the rows its scope allowed."""


class GateRefused(ContractError):
    """The dataset is not loaded, has no contract, has drifted, or its key broke."""
