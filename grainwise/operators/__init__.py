"""The 27 analyses, one module per tier. Importing this package registers them."""

from grainwise.operators import (  # noqa: F401
    compare,
    describe,
    infer,
    people,
    relate,
    time,
    unusual,
)
