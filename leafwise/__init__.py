"""leafwise — structured-extraction evaluation as Spark DataFrame operators.

Every public operator is a ``DataFrame -> DataFrame`` function built on the
Spark SQL API; the only Python that runs inside tasks is the small Arrow
batched assignment kernel (``operators.assignment``) and the stable-string
helper for nested array elements.
"""

from leafwise.session import build_session, ensure_checkpoint_dir

__all__ = ["build_session", "ensure_checkpoint_dir"]
__version__ = "0.1.0"
