"""What runs when: variable catalog, process registry, schedule, compiler and step loop."""
