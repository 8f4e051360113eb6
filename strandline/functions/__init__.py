"""Column functions; each builds an expression that stays in generated code unless its docstring says otherwise."""
