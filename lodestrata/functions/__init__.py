"""Column functions: periodic geometry and potential evaluation."""
