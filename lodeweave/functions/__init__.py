"""Column functions: everything here stays inside the JVM unless its module says otherwise."""
