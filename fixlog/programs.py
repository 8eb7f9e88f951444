"""The library of graph programs, as text for ``Engine.run``."""

# The programs as users know them.
CONNECTED_COMPONENTS = """
l(#X,X):-vertices(X,N,G);
l(#X,MIN(L)):-edges(X,Y),l(Y,L);
"""
PAGERANK = """
pagerank(#X,0,X):-vertices(X,_);
pagerank(#X,I+1,SUM(P+D)):-edges(Y,X),pagerank(Y,I,P),vertices(Y,D),I<10;
"""
PAGERANK_OLD = """
outdegree(#X,COUNT(Y)):-edges(X,Y),vertices(Y,_,_);
pagerank(#X,0,X):-vertices(X,_,_);
pagerank(#X,I+1,SUM(P)):-edges(Y,X),pagerank(Y,I,P),outdegree(Y,D),I<10;
"""
PATHCOUNT = """
pathcount(#X,1):-vertices(X,_,_), X==30;
pathcount(#X,SUM(C)):->edges(X,Y),pathcount(Y,C);
"""
SHORTEST_PATH = """
path(#X,X,0):-vertices(X,_,_), X==66;
path(#X,Z,MIN(D+E)):-edges(X,Y,E), path(Y,Z,D);
"""
SHORTEST_PATH_MUTUAL = """
path(#X,X,0):-vertices(X,_,_),X==66;
path(#X,Z,D+E):-edges(X,Y,E), shortest_path(Y,Z,D);
shortest_path(#X,Y,MIN(D)):-path(X,Y,D);
"""
HOPS_FROM_SOURCE = """
path(#X,0):-vertices(X,_,_), X==1;
path(#Z,MIN(D+1)):-edges(Y,Z,E), path(Y,D);
"""
