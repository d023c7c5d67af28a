"""Column functions: text, dates, links, record fields. All run inside the JVM."""
