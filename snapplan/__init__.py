"""snapplan: incremental, content-addressed snapshots on Spark DataFrames.

Main entry points::

    from snapplan import plan, PlanOptions, plan_summary, run_snapshot, table_files, table_snapshot
"""

__version__ = "0.1.0"

__all__ = ["plan", "PlanOptions", "plan_summary", "run_snapshot", "table_files", "table_snapshot",
           "inventory", "build_session"]


def __getattr__(name):
    # lazy: importing the package does not start Spark
    if name in ("plan", "PlanOptions", "plan_summary", "table_files", "table_snapshot"):
        from .plans import snapshot
        return getattr(snapshot, name)
    if name == "run_snapshot":
        from .plans.run import run_snapshot
        return run_snapshot
    if name == "inventory":
        from .sources.inventory import inventory
        return inventory
    if name == "build_session":
        from .session import build_session
        return build_session
    raise AttributeError(name)
