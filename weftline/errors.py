"""What the library raises for scripts, expressions and statements that aren't valid."""


class ScriptError(ValueError):
    pass
