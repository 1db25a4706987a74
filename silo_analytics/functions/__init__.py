"""Column expressions: hash uniforms, scalar features, vector algebra."""
