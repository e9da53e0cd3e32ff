"""A workspace that remembers, and what is left of one."""

from claimweave.workspace import Workspace, child_names


class Seen(Workspace):
    """Remembers the rows counted of each table."""

    def save(self, df, label, where=None, **options):
        stored = super().save(df, label, where, **options)
        self.__dict__.setdefault("rows", []).append((label, stored.rows))
        return stored


def left(spark, space):
    return {n.split("-", 1)[1] for n in child_names(spark, space.root)}
