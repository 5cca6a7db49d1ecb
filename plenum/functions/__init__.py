"""Column functions: everything here is an expression Catalyst can fold, push and compile."""
