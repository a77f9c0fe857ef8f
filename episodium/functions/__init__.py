"""Column functions: keyed choices, ranks, arrays, poses and prompt text."""
