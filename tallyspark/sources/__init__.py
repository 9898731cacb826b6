"""Where rows come from: tables of a folder, and the roles they play as facts, entities, jobs and labels."""
